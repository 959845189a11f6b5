"""Requests, answers, cursors, cache keys and input checks: what stands around the queries."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalar as S
from ..operators import search

Q_MAX, DEFAULT_LIMIT = 500, 5


class Invalid(ValueError):
    """A request or input with a list of (path, message)."""

    def __init__(self, issues: list[tuple[str, str]]):
        super().__init__("; ".join(f"{p}: {m}" for p, m in issues))
        self.issues = issues


@dataclass(frozen=True)
class Request:
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    mode: str = "excerpts"
    include: tuple[str, ...] = ()
    fallback: str = "none"
    min_rating: int | None = None
    sources: tuple[str, ...] = ()
    since: datetime | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def fold_metadata(filters: dict) -> dict:
    """{"metadata.x": v} as {"metadata": {"x": v}}, added to what stands there."""
    folded = {k.removeprefix("metadata."): v for k, v in filters.items() if k.startswith("metadata.") and k != "metadata."}
    out = {k: v for k, v in filters.items() if k.removeprefix("metadata.") not in folded or not k.startswith("metadata.")}
    if folded:
        before = out.get("metadata")
        out["metadata"] = {**before, **folded} if isinstance(before, dict) else folded
    return out


def parse_since(text: str) -> datetime | None:
    """A date (midnight UTC) or a timestamp with its zone; nothing for anything else."""
    text = text.strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        text += "T00:00:00Z"
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})", text):
        return None
    try:
        return datetime.fromisoformat(text).astimezone(UTC)
    except ValueError:
        return None


def parse_request(body: dict) -> Request:
    """A decoded body, checked; all that is wrong is told at once."""
    issues: list[tuple[str, str]] = []
    known = {"q", "limit", "mode", "include", "fallback", "filters"}
    issues += [(k, "unknown key") for k in body if k not in known]
    q = body.get("q")
    if q is not None:
        q = q.strip() if isinstance(q, str) else ""
        if not q or len(q) > Q_MAX:
            issues.append(("q", f"must have 1 to {Q_MAX} characters"))
    limit = body.get("limit", DEFAULT_LIMIT)
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= C.MAX_SEARCH_LIMIT:
        issues.append(("limit", f"must be within 1..{C.MAX_SEARCH_LIMIT}"))
    include = body.get("include", [])
    include = [include] if isinstance(include, str) else include
    for name, value, allowed in (("mode", body.get("mode", "excerpts"), ("excerpts", "reviews")), ("fallback", body.get("fallback", "none"), ("none", "recent")), *(("include", v, ("text",)) for v in include)):
        if value not in allowed:
            issues.append((name, f"must be one of {', '.join(allowed)}"))
    filters = fold_metadata(body.get("filters") or {})
    issues += [(f"filters.{k}", "unknown key") for k in filters if k not in ("min_rating", "source", "since", "metadata")]
    rating = filters.get("min_rating")
    if rating is not None and not (isinstance(rating, int) and 1 <= rating <= 5):
        issues.append(("filters.min_rating", "must be within 1..5"))
    sources = filters.get("source") or []
    sources = [sources] if isinstance(sources, str) else sources
    if len(sources) > 20 or not all(isinstance(s, str) and 0 < len(s.strip()) <= 64 for s in sources):
        issues.append(("filters.source", "must be up to 20 names"))
    since = filters.get("since")
    parsed = parse_since(since) if isinstance(since, str) else None
    if since is not None and parsed is None:
        issues.append(("filters.since", "must be an ISO 8601 date or timestamp"))
    if issues:
        raise Invalid(issues)
    return Request(q, limit, body.get("mode", "excerpts"), tuple(dict.fromkeys(include)), body.get("fallback", "none"), rating, tuple(s.strip() for s in sources), parsed, dict(filters.get("metadata") or {}))


def parse_params(params: dict[str, str]) -> Request:
    """As `parse_request`, from a query string: numbers as text, lists with commas, filters under filters.* names."""
    body: dict = {k: v for k, v in params.items() if not k.startswith("filters.") and k in ("q", "mode", "fallback")}
    if "limit" in params:
        body["limit"] = int(params["limit"]) if params["limit"].isdigit() else params["limit"]
    if "include" in params:
        body["include"] = [x for x in params["include"].split(",") if x]
    filters: dict = {}
    for k, v in params.items():
        name = k.removeprefix("filters.")
        if name in ("min_rating",):
            filters[name] = int(v) if v.isdigit() else v
        elif name == "source":
            filters[name] = [x.strip() for x in v.split(",") if x.strip()]
        elif name == "since" or name.startswith("metadata."):
            filters[name] = v
    return parse_request({**body, "filters": filters})


def to_query(request: Request, query_id: int, project: dict, vector: list[float] | None = None) -> search.Query:
    """The search that a request asks for, under its project's policy (project_id, environment, min_rating, similarity_floor,
    category), which it can tighten and never loosen.  A request with words needs their vector; one without is the newest reviews."""
    since = int(request.since.timestamp()) if request.since is not None else None
    return search.Query(
        query_id, project["project_id"], project.get("environment", "live"), request.limit, search.effective_min_rating(project["min_rating"], request.min_rating),
        project.get("similarity_floor", C.SIMILARITY_FLOOR), vector if request.q else None, request.q if vector is not None else None, project.get("category"), list(request.sources), since, dict(request.metadata),
    )


def search_and_answer(request: Request, project: dict, reviews: DataFrame, chunks: DataFrame, vector: list[float] | None = None) -> DataFrame:
    """From a request to its JSON answer: the search, the fallback to the newest reviews where it is asked for, and the reviews' columns."""
    q = to_query(request, 0, project, vector)
    newest = lambda: search.recency(reviews, chunks, q).withColumn("similarity", F.lit(None).cast("double"))
    found = newest() if q.vector is None else search.hybrid(reviews, chunks, [q])
    rows, verdict = with_fallback(request, found, newest)
    order = [*([F.col("rrf").desc()] if "rrf" in rows.columns else []), search.newest_first(), "review_id"]
    return answer(search.with_reviews(rows, reviews, chunks).orderBy(*order), request, verdict)


# ---- answers --------------------------------------------------------------------------------------------------


def match_verdict(q: str | None, found: bool) -> str:
    return "recent" if q is None else "query" if found else "none"


def with_fallback(request: Request, rows: DataFrame, recent: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The rows and what they are; only an empty answer is replaced by the newest reviews, never topped up."""
    verdict = match_verdict(request.q, request.q is None or not rows.isEmpty())
    return (recent(), "fallback") if verdict == "none" and request.fallback == "recent" else (rows, verdict)


def highlight() -> Column:
    """Where the excerpt lies in the review (UTF-16 units); none without a query or where it is the whole review."""
    units = F.octet_length(F.encode("excerpt", "UTF-16LE")) / 2
    whole = (F.col("start_offset") == 0) & (F.length("excerpt") == F.length("review_text"))
    return F.when(F.col("similarity").isNotNull() & ~whole, F.struct(F.col("start_offset").cast("int").alias("start"), (F.col("start_offset") + units).cast("int").alias("end")))


def answer(rows: DataFrame, request: Request, verdict: str) -> DataFrame:
    """One JSON object a row, as the service returns it."""
    with_text = request.mode == "reviews" or "text" in request.include
    review = F.struct(
        F.col("review_id").alias("id"), "rating", "author_name", "author_avatar_url", "source", S.iso(F.unix_millis("occurred_at")).alias("occurred_at"), "url", "metadata", *([F.col("review_text").alias("text")] if with_text else [])
    )
    body = F.struct(F.col("similarity").alias("score"), F.lit(verdict == "query").alias("matched"), "excerpt", F.col("chunk_id").alias("excerpt_id"), highlight().alias("highlight"), review.alias("review"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


# ---- cursors and cache keys -----------------------------------------------------------------------------------


def encode_cursor(occurred: str | None, ident: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": occurred, "i": ident}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(raw: str) -> tuple[str | None, str] | None:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", raw):
        return None
    try:
        value = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    except ValueError:
        return None
    if not isinstance(value, dict) or set(value) != {"o", "i"} or not isinstance(value["i"], str) or not (value["o"] is None or isinstance(value["o"], str) and parse_since(value["o"])):
        return None
    return value["o"], value["i"]


def location_cursors(text: Column) -> Column:
    """Each location's cursor from stored JSON; anything that is no object of strings is empty."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def query_url(base: str, request: dict) -> str:
    """The address that asks for a request: metadata keys sorted, the limit brought within bounds."""
    from urllib.parse import urlencode

    pairs = [(k, request[k]) for k in ("q", "mode", "fallback") if request.get(k)]
    if request.get("limit") is not None:
        pairs.append(("limit", min(C.MAX_SEARCH_LIMIT, max(1, int(request["limit"])))))
    pairs += [(f"metadata.{k}", v) for k, v in sorted((request.get("metadata") or {}).items())]
    return f"{base}?{urlencode(pairs)}" if pairs else base


def parse_list_params(params: dict[str, str]) -> dict:
    """Parameters of the lists in a browser: what can't be read is left at its default."""
    number = lambda k, low, high, default: int(params[k]) if params.get(k, "").isdigit() and low <= int(params[k]) <= high else default
    among = lambda k, allowed: params[k] if params.get(k) in allowed else None
    cursor = decode_cursor(params.get("cursor", "")) if params.get("cursor") else None
    return {"limit": number("limit", 1, 100, 20), "min_rating": number("min_rating", 1, 5, None), "source": among("source", C.SOURCES), "hidden": among("hidden", ("true", "false", "all")) or "false", "indexed": among("indexed", ("true", "false")), "since": parse_since(params["since"]) if params.get("since") else None, "cursor": cursor}


def canonical_json(value) -> str:
    """Keys sorted at every level, dates as ISO strings."""
    iso = lambda d: d.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=iso)


def cache_key(request: Request, project: str, environment: str, generation: int, policy: dict | None = None) -> str:
    """The same for requests that must have the same answer: text normalised, lists without order, policy and generation in."""
    q = None if request.q is None else re.sub(r"\s+", " ", request.q.strip()).lower()
    identity = {
        "q": q, "limit": request.limit, "mode": request.mode, "include": sorted(request.include), "fallback": request.fallback,
        "filters": {"min_rating": request.min_rating, "source": sorted(set(request.sources)) or None, "since": request.since, "metadata": request.metadata or None},
        "policy": policy and {**policy, "lexical_floor": C.lexical_floor(policy["similarity_floor"]), "generic_words": " ".join(C.generic_words(policy.get("category")))},
    }
    return f"q:{project}:{environment}:{generation}:{hashlib.sha256(canonical_json(identity).encode()).hexdigest()}"


class ResultCache:
    """Answers by key on the driver: stored from the second miss on, gone after a day or with the project's next generation."""

    def __init__(self, seconds: float = 86_400, most: int = 10_000):
        self.seconds, self.most = seconds, most
        self.entries: dict[str, tuple[float, object]] = {}
        self.missed: dict[str, int] = {}
        self.generations: dict[str, int] = {}

    def bump(self, projects: set[str]) -> None:
        for p in projects:
            self.generations[p] = self.generations.get(p, 0) + 1

    def get(self, key: str, now: float):
        found = self.entries.get(key)
        if found and now - found[0] < self.seconds:
            return found[1]
        self.missed[key] = self.missed.get(key, 0) + 1
        return None

    def put(self, key: str, value, now: float) -> bool:
        if self.missed.get(key, 0) < 2:
            return False
        while len(self.entries) >= self.most:
            self.entries.pop(next(iter(self.entries)))
        self.entries[key] = (now, value)
        self.missed.pop(key, None)
        return True


# ---- input ----------------------------------------------------------------------------------------------------


def review_issues() -> Column:
    """What is wrong with a pushed review, as an array of (path, message); empty where it is good."""
    bad = lambda test, path, message: F.when(F.coalesce(test, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    size = lambda c, most: ~F.length(S.trimmed(F.col(c))).between(1, most)
    caps, out = C.REVIEW_CAPS, []
    out += [bad(size(c, caps[c]), c, f"must have 1 to {caps[c]} characters") for c in ("external_id", "text", "author_name")]
    out.append(bad(~F.col("source").isin(*C.SOURCES), "source", "must be a known source"))
    out.append(bad(F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), "rating", "must be within 1..5 or null"))
    out.append(bad(S.parse_date_ms(F.col("occurred_at")).isNull() | ~F.rlike("occurred_at", F.lit(r"(Z|[+-]\d{2}:?\d{2})$")), "occurred_at", "must be ISO 8601 with a zone"))
    out += [bad(F.col(c).isNotNull() & ~S.is_http_url(F.col(c)), c, "must be a URL") for c in ("url", "author_avatar_url")]
    out.append(bad(F.col("language").isNotNull() & ~F.length("language").between(2, caps["language"]), "language", "must have 2 to 35 characters"))
    entries = F.coalesce(F.map_entries("metadata"), F.array().cast("array<struct<key:string,value:string>>"))
    wrong = F.exists(entries, lambda e: ~F.length(e["key"]).between(1, caps["metadata_key"]) | e["value"].isNull() | (F.length(e["value"]) > caps["metadata_value"]))
    out.append(bad((F.size(entries) > caps["metadata"]) | wrong, "metadata", "must have at most 32 short entries"))
    return F.array_compact(F.array(*out))


def checked(batch: DataFrame) -> DataFrame:
    """A pushed batch with the issues of each review; a batch is taken whole or not at all."""
    return batch.withColumn("issues", review_issues())


def run_totals(records: DataFrame) -> DataFrame:
    """Run records summed: each batch adds a record of deltas, the last one closes the run."""
    sums = ("received", "created", "updated", "skipped", "failed")
    out = records.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in sums], F.max_by("status", "at").alias("status"))
    return out.withColumn("processed", F.col("created") + F.col("updated") + F.col("skipped") + F.col("failed"))


def send_batches(ids: list, send: Callable[[list], bool], size: int = 100) -> tuple[list, list]:
    """Messages in batches; once one is refused for quota, it and the rest are deferred (they stay to be indexed)."""
    for k in range(0, len(ids), size):
        if not send(ids[k : k + size]):
            return ids[:k], ids[k:]
    return ids, []


def annotate(rows: DataFrame, marks: DataFrame, key: str = "chunk_id", column: str = "lexical") -> DataFrame:
    """Evaluation rows with a mark each by excerpt; one without a mark is an error."""
    joined = rows.drop(column).join(marks.select(key, column, F.lit(True).alias("_has")), key, "left")
    return joined.withColumn(column, F.when(F.col("_has"), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no mark for "), F.col(key).cast("string"))).cast("boolean"))).drop("_has")
