"""Phrase families, character sets and feature weights.

Everything between the FIXED VALUES markers must stay equal to the
original stylometry rules, or scores change. The lists are kept as
written there (same order, duplicates included); any reduction needed
for regex matching is done by code in :mod:`penmark.functions.phrases`.
"""

from __future__ import annotations

import hashlib
import json

# ---------------------------------------------------------------- FIXED VALUES
# Phrase families. Matching is on the lower-cased, flattened text (T2),
# plain substrings, no word boundaries.

BUZZWORD = [
    "the app", "-powered", "-melting", "powered by", "based on", "-like",
    "todo app", "interactive cards", "modern", "delivers", "delivers both",
    "across all devices", "style and usability", "real-time",
    "calm, reflective space", "simulate", "self-care", "meaningful",
    "user interaction", "digital wellness", "user-friendly interface",
    "responsive", "auto-typing", "engagement", "community", "ambitious goal",
    "world of data", "programming toolkit", "summer of learning",
    "and a custom", "foundational principles", "began to wonder",
    "i'm announcing", "i’m announcing", "fully featured", "next.js 13",
    "next.js 14", "next.js 13/14", "svelte 4", "app router", "modern",
    "web dashboard", "step-by-step", "excited", "build this",
    "inner workings", "live code editor", "new project", "kicking off",
    "lightweight", "in the browser", "brutalism", "morphism",
    "comprehensive", "philosophy", "revolutionary", "wisdom", "leetcode",
    "global accessibility", "developers",
    "harmony of tradition and innovation", "intuitive", "powerful features",
    "cross-platform", "inspiration", "technical architecture", "users can",
    "rewarding feel", "progress tracking", "understandable",
    "digital co-pilot", "significantly improves usability",
    "easier to navigate", "react for the frontend", "stylish", "mobile-",
    "ui/ux", "the single solution", "fully customizable",
    "about to change everything", "solved that problem",
    "the same tech behind", "lives in its own", "is like a", "kubernetes",
    "orchestrated", "microservices architecture", "corporate jargon", "✨",
    "buttery-smooth", "biggest competitor", "it lets you",
]

NEGATIVE_BUZZWORD = ["modern english", "made the app"]

FANCY = ["(e.g.", "(formerly"]

NOT_JUST = [
    "more than just", "isn’t a", "isn't a", "this isn’t a prototype",
    "isn’t just a", "isn't just a", "it’s not just", "it's not just",
    "i'm not just", "i’m not just", "it’s just not", "it's just not",
    "i'm just not", "i’m just not", "isn’t just", "isn't just",
    "didn't just", "didn’t just", "more than a", "it’s more", "it's more",
]

DEVLOG = [
    "dev log", "dev-log", "day", "devlog #", "dev log #", "dev-log #",
    "day #", "first devlog", "today,", "june ", "july ", "august ", "jun ",
    "jul ", "aug ", "-06-", "-07-", "-08-", "/06/", "/07/", "/08/", ".06.",
    ".07.", ".08.", "/6/", "/7/", "/8/", "this week was all about",
    "the project", "what’s next", "what's next", "next steps",
    "why it matters", "more coming soon", "what i built",
]

ELLIPSIS = ["…", "..."]

PERSPECTIVE = [
    " we're ", " we ", " they're ", " us ", " our ", " ours ", " ourselves ",
    " them ", " people ", " theirs ", " themselves ", " oneself ",
]

BACKSTORY = [
    "as a", "high school student", "middle school student", "preparing for",
    "exams", "was born from", "personal frustration", "makes it unique",
    "and eventually", "the intention", "it’s been a journey",
    "it's been a journey", "a journey", "it’s all about", "it's all about",
    "leverage that knowledge", "dive into", "become a versatile programmer",
    "my adventure", "foundational principles", "how computers truly work",
    "the world of data", "an ambitious goal", "excited to build",
    "programming toolkit", "summer of learning", "something insane",
    "think of it like", "drowning in", "last week", "next week",
]

# Single characters counted per grapheme on T2.
DASH_CHARS = "–—‒―⸻⸺−﹘－‑‐᠆־֊"
ARROW_CHARS = "→↑↓↔↕⇒⇐⇑⇓➔➜"
QUOTE_CHARS = "“”‘’"
BULLET = "•"
HTML_ESCAPE = "&amp;"

# The 15 metrics in record order, and the feature vector: (metric, weight)
# in vector order.
METRIC_ORDER = [
    "emoji_rate", "buzzword_rate", "not_just_count", "html_escape_count",
    "devlog_count", "backstory_count", "incorrect_perspective_count",
    "mr_fancy_pants", "irregular_ellipsis", "irregular_quotations",
    "irregular_dashes", "irregular_markdown", "irregular_arrows", "labels",
    "hashtags",
]

FEATURE_WEIGHTS = [
    ("emoji_rate", 2.0), ("buzzword_rate", 10.0), ("irregular_dashes", 20.0),
    ("irregular_quotations", 5.0), ("labels", 1.0),
    ("irregular_ellipsis", 1.0), ("html_escape_count", 5.0),
    ("not_just_count", 5.0), ("devlog_count", 1.0),
    ("irregular_markdown", 1.0), ("hashtags", 1.0), ("mr_fancy_pants", 1.0),
    ("incorrect_perspective_count", 1.0), ("backstory_count", 1.0),
    ("irregular_arrows", 20.0),
]

# Multipliers inside the two rate metrics.
EMOJI_RATE_FACTOR = 5
BUZZWORD_RATE_FACTOR = 2

# Short names and order of the two-column metrics summary text.
SUMMARY_NAMES = [
    ("emoji", "emoji_rate"), ("not_just", "not_just_count"),
    ("buzzword", "buzzword_rate"), ("html", "html_escape_count"),
    ("irr_ell", "irregular_ellipsis"), ("irr_quote", "irregular_quotations"),
    ("irr_dash", "irregular_dashes"), ("irr_arr", "irregular_arrows"),
    ("irr_md", "irregular_markdown"), ("fancy", "mr_fancy_pants"),
    ("bad_per", "incorrect_perspective_count"), ("devlog", "devlog_count"),
    ("labels", "labels"), ("hashtags", "hashtags"),
    ("backstory", "backstory_count"),
]

# Training defaults.
DEFAULT_K = 2
DEFAULT_RUNS = 10
DEFAULT_MAX_ITER = 1000
DEFAULT_TOL = 1e-4
DEFAULT_SEED = 69420
# ------------------------------------------------------------ END FIXED VALUES

FAMILIES = {
    "buzzword": BUZZWORD,
    "negative": NEGATIVE_BUZZWORD,
    "fancy": FANCY,
    "not_just": NOT_JUST,
    "devlog": DEVLOG,
    "ellipsis": ELLIPSIS,
    "perspective": PERSPECTIVE,
    "backstory": BACKSTORY,
}



def digest(lexicons: dict[str, list[str]] | None = None) -> str:
    """SHA-256 of the phrase families in force: the fixed lists, with those
    replaced that ``lexicons`` names. The order of phrases and repeated ones
    don't count, as they don't change a count."""
    families = {**FAMILIES, **(lexicons or {})}
    whole = json.dumps({f: sorted(set(p)) for f, p in families.items()}, sort_keys=True)
    return hashlib.sha256(whole.encode()).hexdigest()


FEATURE_NAMES = [f"f{i}" for i in range(len(FEATURE_WEIGHTS))]
N_FEATURES = len(FEATURE_WEIGHTS)
