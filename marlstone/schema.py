"""Column types of the stored tables and the file shapes, as DDL."""

from __future__ import annotations

REVIEWS = (
    "id string, project_id string, environment string, source string, external_id string, rating smallint, text string, author_name string, author_avatar_url string, "
    "url string, language string, occurred_at timestamp, metadata map<string,string>, sentiment string, sentiment_source string, hidden_at timestamp, indexed_at timestamp, "
    "index_attempts smallint, created_at timestamp, updated_at timestamp"
)
CHUNKS = ("id string, review_id string, project_id string, environment string, kind string, text string, start_offset int, embedding array<float>, lexemes map<string,array<int>>, created_at timestamp")
PROJECTS = ("id string, account_id string, name string, slug string, allowed_origins array<string>, min_rating smallint, similarity_floor double, show_badge boolean, review_count int, category string, created_at timestamp")
ACCOUNTS = ("id string, clerk_org_id string, name string, plan string, created_at timestamp, deleted_at timestamp, onboarding_completed_at timestamp, created_by_user_id string")
API_KEYS = ("id string, project_id string, kind string, environment string, key_hash string, prefix string, created_at timestamp, last_used_at timestamp, revoked_at timestamp")
CONNECTIONS = ("id string, project_id string, kind string, status string, credentials string, cursor string, metadata string, last_synced_at timestamp")
INGEST_RUNS = ("id string, project_id string, environment string, kind string, status string, received int, created int, updated int, skipped int, failed int, error string, artifact_key string, started_at timestamp, finished_at timestamp")
USAGE = ("project_id string, month date, queries bigint, cache_hits bigint")
WAITLIST = ("id string, email string, source string, created_at timestamp")

REVIEW_INPUT = (
    "external_id string, source string, rating smallint, text string, author_name string, author_avatar_url string, occurred_at string, url string, language string, metadata map<string,string>"
)
TAKEOUT_REVIEW = "struct<name:string,reviewer:struct<displayName:string,profilePhotoUrl:string>,starRating:string,comment:string,createTime:string,updateTime:string,reviewReply:struct<comment:string,updateTime:string>>"
TAKEOUT_PAGE = f"struct<reviews:array<{TAKEOUT_REVIEW}>,attributes:array<struct<id:struct<attributeType:string>,values:array<struct<datum:struct<listingName:struct<text:string>>>>>>,type:string,features:array<string>>"
BUSINESS_REVIEW = "struct<name:string,reviewId:string,reviewer:struct<displayName:string,isAnonymous:boolean,profilePhotoUrl:string>,starRating:string,comment:string,createTime:string,updateTime:string,reviewReply:struct<comment:string,updateTime:string>>"
PLACE = "struct<id:string,displayName:struct<text:string,languageCode:string>,formattedAddress:string,rating:double,userRatingCount:int,primaryType:string,reviews:array<struct<name:string,rating:double,text:struct<text:string,languageCode:string>,originalText:struct<text:string,languageCode:string>,authorAttribution:struct<displayName:string,uri:string,photoUri:string>,publishTime:string>>>"
MESSAGE = ("type string, reviewId string, projectId string, environment string, connectionId string")
