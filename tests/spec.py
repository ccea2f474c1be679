"""Plain-Python statements of the rules, for comparison with the Column expressions."""

from __future__ import annotations

import re

from paperloom.functions import lexicon as L


def lines(text):
    return [x.strip() for x in text.split("\n") if x.strip()]


def clamp(value, low, high):
    return int(max(low, min(high, round(value))))


BULLET = re.compile(r"^[\s\-•‣◦*⁃∙]+|^\d+[.)]\s*")
METRIC = re.compile(r"\d+(\.\d+)?\s?%|[$€£]\s?\d[\d,]*|\b\d+(\.\d+)?\s?(x|k|K|m|M|million|billion|thousand)\b|\b\d{2,}\b")


def structure(text):
    if not text:
        return 0
    blocks = [b for b in re.split(r"\n\s*\n", text) if b.strip()]
    own = lines(text)
    share = sum(bool(BULLET.match(x)) for x in own) / len(own) if own else 0
    return clamp(12 * min(1, len(blocks) / 5) + 8 * min(1, share / 0.30), 0, 20)


def formatting(text):
    own = lines(text)
    if not own:
        return 0
    mean = sum(map(len, own)) / len(own)
    band = 20 if mean < 20 else 100
    ratio = 1.0 if 20 <= mean <= 100 else max(0.0, 1 - abs(mean - band) / band)
    share = sum(len(x) > 200 for x in own) / len(own)
    return clamp(8 * ratio + 7 * max(0.0, 1 - share / 0.15), 0, 15)


def achievements(text):
    own = lines(text)
    if not own:
        return 0
    metrics = sum(bool(METRIC.search(x)) for x in own)

    def verb(x):
        bare = BULLET.sub("", x).strip()
        return bool(bare) and re.split(r"\s+", bare)[0].strip(".,;:!()").lower() in L.ACTION_VERBS

    verbs = sum(map(verb, own))
    return clamp(15 * min(1, metrics / len(own) / 0.30) + 10 * min(1, verbs / len(own) / 0.40), 0, 25)


def keywords(text, terms):
    if not text:
        return 0
    return clamp(25 * min(1, sum(bool(re.search(r"\b" + re.escape(t) + r"\b", text.lower())) for t in terms) / 15), 0, 25)
