"""What results must agree on."""

from __future__ import annotations

ENVIRONMENTS = ("live", "test")
SOURCES = ("google", "yelp", "facebook", "trustpilot", "custom")
SENTIMENTS = ("positive", "neutral", "negative")
#: In the order in which they sort.
CHUNK_KINDS = ("full", "window", "sentence")

RRF_K = 60
MAX_SEARCH_LIMIT = 20
EMBEDDING_DIMENSIONS = 1024
SIMILARITY_FLOOR = 0.66
LEXICAL_FLOOR_OFFSET = 0.13
RERANK_FLOOR = 0.85
NEUTRAL_THRESHOLD = 0.6
MAX_INDEX_ATTEMPTS = 5
RATE_PERIOD_SECONDS = 60
ANONYMOUS = "Anonymous"
EXTERNAL_ID_PREFIX = 64

PLANS = {
    "free": {"projects": 1, "reviews_per_project": 5_000, "queries_per_month": 50_000, "badge": True, "secret": 300, "publishable": 120},
    "paid": {"projects": 50, "reviews_per_project": 100_000, "queries_per_month": 2_000_000, "badge": False, "secret": 1_000, "publishable": 600},
}

UNIVERSAL_GENERIC_WORDS = ("review", "reviews", "company", "service", "business", "office", "team")
#: category: (words, business types)
CATEGORIES = {
    "dental": ("dental dentist teeth", "dentist dental_clinic cosmetic_dentist"),
    "roofing": ("roof roofing roofer roofers contractor", "roofing_contractor"),
    "plumbing": ("plumber plumbers plumbing", "plumber"),
    "hvac": ("hvac heating cooling air conditioning contractor", "hvac_contractor air_conditioning_contractor heating_contractor"),
    "electrical": ("electrician electricians electrical electric", "electrician electrical_contractor"),
    "remodeling": ("remodel remodeling remodeler renovation contractor construction builder home", "general_contractor remodeler kitchen_remodeler bathroom_remodeler construction_company home_builder"),
    "legal": ("lawyer lawyers attorney attorneys law firm legal", "lawyer law_firm attorney"),
    "medical": ("doctor doctors physician medical clinic", "doctor medical_clinic medical_center hospital family_practice_physician"),
    "veterinary": ("vet vets veterinarian veterinary animal pet clinic", "veterinary_care veterinarian animal_hospital"),
    "salon": ("salon hair stylist barber beauty", "hair_salon hair_care beauty_salon barber_shop nail_salon"),
    "fitness": ("gym fitness club workout", "gym fitness_center"),
    "restaurant": ("restaurant food dining eat", "restaurant meal_takeaway meal_delivery"),
    "cafe": ("cafe café coffee shop", "cafe coffee_shop"),
    "auto_repair": ("mechanic mechanics auto car cars shop garage", "car_repair auto_repair_shop mechanic"),
    "real_estate": ("realtor realtors agent real estate realty broker", "real_estate_agency real_estate_agent"),
}

STAR_NAMES = ("ONE", "TWO", "THREE", "FOUR", "FIVE")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: Words that the hashed embedding leaves out.
EMBED_STOP_WORDS = frozenset("a an and are as at be but by for from had has have he her his i in is it its me my of on or our she so that the their them they this to was we were with you your".split())
POSITIVE_WORDS = frozenset("amazing best excellent fantastic friendly gentle good great happy helpful kind love loved painless perfect professional recommend wonderful".split())
NEGATIVE_WORDS = frozenset("awful bad confusing disappointed disappointing horrible mess never overpriced painful poor rude slow terrible unprofessional waste worst wrong".split())

#: Abbreviations after which a sentence may go on, and those after which it always does.
ABBREVIATIONS = frozenset("dr mr mrs ms jr sr st mt vs prof inc ltd co corp e.g i.e etc approx dept est no vol ave blvd rd".split())
ALWAYS_MERGED = frozenset("dr mr mrs ms prof st mt vs e.g i.e".split())

#: English stop words of full-text search.
ENGLISH_STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

REVIEW_CAPS = {"external_id": 512, "text": 20_000, "author_name": 256, "language": 35, "metadata": 32, "metadata_key": 64, "metadata_value": 512}
COLLECTION_KEYS = ("reviews", "data", "items", "results", "records")


def generic_words(category: str | None = None) -> list[str]:
    """The universal generic words and the category's own, each once."""
    own = CATEGORIES[category][0].split() if category in CATEGORIES else []
    return list(dict.fromkeys([*UNIVERSAL_GENERIC_WORDS, *own]))


def lexical_floor(floor: float) -> float:
    """The lower floor that rows with matching words need only reach."""
    import math

    return max(0.0, math.floor((floor - LEXICAL_FLOOR_OFFSET) * 1e6 + 0.5) / 1e6)
