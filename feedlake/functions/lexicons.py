"""Word lists, weights and patterns. Results depend on each of them."""

from __future__ import annotations

# Sentiment words.
POSITIVE_WORDS = (
    "amazing great excellent awesome good beautiful successful improve innovative excited "
    "progress advance breakthrough launch release win achievement benefit powerful growth "
    "high positive strong optimize robust healthy"
).split()
NEGATIVE_WORDS = (
    "bad fail error broken critical severe issue crash bug terrible poor worse decrease "
    "decline unsuccessful harmful negative weak disaster vulnerability risk danger loss "
    "failed unstable warning"
).split()

# Stop words per language.
ENGLISH_STOP_WORDS = (
    "the a an and or but in on at to for with by of from is are was were be been this that "
    "it its they them their we us our you your i my me he him his she her has have had do "
    "does did as if then else not no about which there there's hasn't haven't can can't will "
    "would should could all any both each few more most other some such than too very s t "
    "just now new"
).split()
PERSIAN_STOP_WORDS = (
    "از به با در تا که این آن یک را و یا اما برای شد بود است هست می کند کنند کرد کردند شدن "
    "داشت دارد هم همه روی زیر بین پیش پس چون اگر حتی باید شاید بنابر بنابراین دیگر بر خود وی آنها"
).split()

# Urgency triggers; sums are taken in this order.
URGENCY_WEIGHTS = {
    "breaking": 0.4,
    "critical": 0.5,
    "vulnerability": 0.6,
    "breakthrough": 0.3,
    "alert": 0.4,
    "urgent": 0.5,
    "security": 0.3,
    "exploit": 0.5,
    "warning": 0.3,
    "hotfix": 0.4,
    "emergency": 0.6,
}

# Tags and the keywords that raise them; tags come out in this order.
TAG_KEYWORDS = {
    "ai": ["ai", "artificial intelligence", "machine learning", "llm", "ollama"],
    "tech": ["technology", "software", "development", "programming", "python"],
    "news": ["announcement", "release", "launch", "breaking"],
}

# Code points counted as Persian or Arabic letters.
PERSIAN_RANGES = "\u0600-\u06FF\u0750-\u077F\uFB50-\uFDFF\uFE70-\uFEFF"

# Names whose values are masked.
SECRET_TERMS = ("key", "secret", "password", "token")

# What each role may do, and what each route asks for.
ROLE_PERMISSIONS = {
    "admin": [
        "read:articles", "write:articles", "read:sources", "write:sources",
        "read:scheduler", "write:scheduler", "read:stats", "admin",
    ],
    "viewer": ["read:articles", "read:stats"],
}
ROUTE_PERMISSIONS = {
    "/api/articles": "read:articles",
    "/api/articles/*": "read:articles",
    "/api/feed": "read:articles",
    "/api/sources": "read:sources",
    "/api/scheduler": "read:scheduler",
    "/api/stats": "read:stats",
}
