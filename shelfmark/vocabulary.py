"""Controlled vocabularies. All values here are fixed: results depend on them as they stand."""

from __future__ import annotations

# Fixed values.
PLACE_TYPES = ("restaurant", "lodging", "shop", "place", "transport")
OTHER_TYPES = ("product", "brand", "service", "exercise", "recipe", "method", "media", "person", "other")
TYPES = PLACE_TYPES + OTHER_TYPES
PROPER_NOUN_TYPES = ("restaurant", "lodging", "shop", "place", "transport", "brand", "person", "media")
SCALES = ("city", "district", "site")
FACETS = {
    "food": ("ramen", "noodles", "sushi", "tempura", "street_food", "dessert", "bakery", "cafe", "bar", "breakfast", "vegetarian"),
    "nature": ("beach", "waterfall", "gorge", "forest", "mountain", "cave", "garden"),
    "heritage": ("temple", "church", "abbey", "castle", "museum", "monument"),
    "urban": ("market", "street", "viewpoint"),
    "body": ("back", "hips", "shoulders", "legs", "mobility", "strength", "stretching"),
    "object": ("cooking", "photo", "video", "clothing", "beauty", "hair", "outdoor"),
    "style": ("design", "craft", "vintage", "luxury", "budget"),
    "media": ("anime", "film", "series", "book", "music", "podcast", "game", "documentary"),
}
FAMILIES_BY_TYPE = {
    "restaurant": ("food", "style", "urban"),
    "lodging": ("style", "nature", "urban"),
    "shop": ("food", "object", "style", "urban"),
    "place": ("nature", "heritage", "urban", "style", "food"),
    "transport": ("urban", "style"),
    "product": ("object", "style", "food", "body"),
    "brand": ("object", "style", "food", "body"),
    "service": ("object", "style", "urban"),
    "exercise": ("body",),
    "recipe": ("food", "object"),
    "method": ("object", "body", "style", "food"),
    "person": ("style", "object", "body", "food"),
    "media": ("media",),
    "other": tuple(FACETS),
}
MAX_FACETS = 3
ARTICLES = ("le", "la", "les", "un", "une", "des", "du", "de", "d")
BLANK_WORDS = ("inconnu", "inconnue", "unknown", "n/a", "na", "-", "?")
SOURCE_PRIORITY = {"caption": 4, "account": 3, "ocr": 2, "transcript": 1}
SOURCE_CONFIDENCE = {"caption": 0.99, "account": 0.98, "ocr": 0.95, "transcript": 0.6}
TAG_RANK = {"free": 0, "collection": 1, "controlled": 2}
VERDICTS = ("want_to_try", "liked", "favorite", "disappointing", "avoid")
STATUSES = ("considering", "shortlisted", "owned", "favorite", "disappointing", "avoid")
CONTENT_KINDS = ("recipe", "exercise", "lesson", "method", "guide", "inspiration")
STOP_WORDS = ("avec", "dans", "pour", "quel", "quelle", "quels", "quelles", "des", "les", "une", "est", "sur", "the", "and", "que", "mon", "mes", "moi", "voir", "trouver", "veux")
REVIEW_ORDER = ("evidence", "rejected", "silent", "uncertain")
THEMES = (
    ("Food & restaurants", ("recipe", "restaurant"), ("cuisine", "food", "restaurant", "recette", "izakaya", "gastronomie")),
    ("Learning & languages", ("lesson",), ("langue", "language", "japonais", "vocabulaire", "phrase")),
    ("Sport & wellbeing", ("exercise",), ("sport", "fitness", "workout", "yoga", "bien etre", "wellness")),
    ("Travel & places", ("place", "lodging", "transport"), ("voyage", "travel", "roadtrip", "citytrip", "visit", "tourisme", "excursion")),
    ("Shopping & products", ("product", "brand", "shop"), ("shopping", "souvenir", "cadeau", "achat", "occasion")),
    ("Culture & media", ("media",), ("anime", "art", "culture", "streaming", "fantasy", "histoire")),
    ("Home & DIY", (), ("maison", "mobilier", "decoration", "canape", "diy", "rangement", "nettoyage")),
    ("Nature & outdoors", (), ("nature", "randonnee", "montagne", "panorama", "outdoor", "plage")),
    ("Style & beauty", (), ("mode", "beaute", "beauty", "skincare", "vintage")),
    ("Tech & creation", (), ("ia", "photographie", "photo", "tech", "camera", "design")),
)

# Tags that mark sport.
SPORT_TAGS = (
    "sport", "fitness", "workout", "yoga", "mobilite", "souplesse", "etirement", "renforcement", "musculation", "course", "tennis", "calisthenie", "posture", "abdominaux", "gainage", "echauffement",
    "entrainement", "preparation physique",
)
