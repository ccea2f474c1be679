"""Training of the personal-data tagger from labelled spans.

Spans are labelled on a bounded sample of rows: names by the structured fields of the same
rows and the given names those fields hold, the other kinds by their written forms. The
network learns them from the characters and their surroundings, with noise of the kinds
that texts carry. Run ``python -m paperloom.llm.pii_train RESUMES.parquet`` to fit the
weights anew; the sample's size is ``SAMPLE``. With ``--on`` after the file, the weights
at hand are trained on for ``MORE`` epochs at half the rate.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np

from paperloom.llm.names import NICK
from paperloom.llm.pii import KINDS, LABELS, MODEL, WINDOW, Tagger, char_ids, load, stretches

#: Rows that are labelled at most.
SAMPLE = 4000
SIZE, EMBED, VOCABULARY = 32, 16, 101
EPOCHS, BATCH, RATE = 16, 128, 0.006
#: Epochs in which each window without an item is seen once.
TURNS, MORE = 5, 3

#: Blanks between the parts of a name, over one line end at most.
_GAP = r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)"
_TITLE = rf"(?:(?:Dr|Prof|Doctor|Professor|Sir|Dame)\b\.?{_GAP})"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_A-ZÀ-ÖØ-Þ]+"
_SURNAME = rf"{_CAP}(?:-{_CAP})?"
_UPPER = r"[^\W\d_a-zß-öø-ÿ]{3,}(?:-[^\W\d_a-zß-öø-ÿ]{3,})?"
_STREET = r"(?:Avenue|Terrace|Road|Street|St|Close|Way|Drive|Row|Court|Lane|Place|Square|Gardens|Grove|Crescent|Walk|Mews|Parade|Quay|Hill|Rise|Park|Green)"
_TOWN = rf"(?:,\s+{_CAP}(?:\s+[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}})?)?"
#: In these forms "~" stands for blanks of any kind, spare ones included.
_FORMS = {
    "email": [
        r"<?[\w.+\-]+ ?@ ?[\w\-]+(?: ?\. ?[\w\-]+)+>?",
        r"[\w.+\-]+ ?(?:\(at\)|\[at\]|\{at\}| AT ) ?[\w\-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| DOT |\.) ?[\w\-]+)+",
    ],
    "identity_number": [r"\bQQ(?:~)?\d\d(?:~)?\d\d(?:~)?\d\d(?:~)?[A-Z]\b", r"\bX\d{8}\b", r"\b\d{3}\.\d{3}\.\d{3}-\d\d\b", r"\b9\d\d(?:-|~)\d\d(?:-|~)\d{4}\b"],
    "phone": [
        r"\+\d{1,3}(?:[\d().\-]|~){7,22}\d(?:\s+ext\.\s*\d+)?", r"\b00\d\d~\(0\)\d\d~\d{4}~\d{4}", r"\(0\)\d\d~\d{5}~\d{3}", r"\b0\d{2}~\d{4}~\d{4}\b", r"\b07\d{3}~\d{6}\b",
        r"(?<![\d\-.])\d{3}(?:-|\.|~)\d{3}(?:-|\.|~)\d{4}\b(?:\s+ext\.\s*\d+)?", r"\(\d{3}\)~\d{3}-\d{4}",
    ],
    "address": [
        rf"(?:Flat\s+\d+[A-Z]?,\s+)?\b\d{{1,4}}[A-Z]?\s+(?:{_CAP}\s+){{1,2}}{_STREET}\b\.?(?:,\s+Apt\s+\d+)?{_TOWN}", rf"\bP\.?\s?O\.?\s+Box\s+\d+{_TOWN}",
        rf"\b\d{{1,4}}[A-Z]?,?\s+rue\s+(?:des|du|de\s+la|de)?\s*{_CAP}(?:,\s+{_CAP})?", rf"\b{_CAP}(?:allee|gasse|straße|strasse|weg|platz)\s+\d{{1,4}}[a-z]?(?:,\s+\d{{5}}\s+{_CAP})?",
    ],
}
_COMPILED = {k: [re.compile(f.replace("~", r"[ \u00a0\u2000-\u200a\u202f]{1,3}")) for f in forms] for k, forms in _FORMS.items()}
_ORG = re.compile(r"(?i)univ|acad|press|board|inst|journal|\bj\.|soc|council|cncl|assoc|college|dep|cent|ctr|found|fdn|cham|group|grp|system|feder|proc|conf|online|unknown|n/a|various|self|training|corp|engrs|exam|&|\b(?:ltd|gmbh|inc|e\.v)\b")


_INITIAL = re.compile(rf"{_TITLE}?(?<![^\W_])[^\W\d_a-zß-öø-ÿ]\.\s+{_SURNAME}(?![^\W_])|\b{_SURNAME},\s+{_TITLE}?[^\W\d_a-zß-öø-ÿ]\.")


def surnames_of(rows: list[list[str]]) -> set[str]:
    """Surnames that the fields hold."""
    out = set()
    for own in rows:
        for name in own:
            m = re.fullmatch(rf"(?:{_CAP}|[^\W\d_a-zß-öø-ÿ]\.) ({_SURNAME})", name)
            if m:
                out.add(m.group(1))
    return out


_PERSON = re.compile(r"\b(?:Dr|Prof|Sir|Dame|Doctor|Professor)\b|(?<![^\W_])[^\W\d_]\.|\b(?:" + "|".join(sorted({n.capitalize() for n in NICK} | {k.capitalize() for v in NICK.values() for k in v.split()})) + r")\b")


class Labeller:
    """Labels the spans of one row, given the given names that the sample's fields hold."""

    def __init__(self, given: set[str], surnames: set[str] = frozenset()):
        ends: Counter[str] = Counter()
        for surname in {part for s in surnames for part in s.split("-")}:
            for k in range(3, 7):
                if len(surname) >= k + 3:
                    ends[surname[-k:]] += 1
        #: endings that many surnames share
        self.ends = tuple(e for e, n in ends.items() if n >= 6)
        some = "|".join(sorted((re.escape(g) for g in given), key=len, reverse=True))
        loud = "|".join(sorted((re.escape(g.upper()) for g in given), key=len, reverse=True))
        self.names = [
            re.compile(rf"{_TITLE}?\b(?:{some})(?:{_GAP}[A-Z]\.)?{_GAP}(?!and\b){_SURNAME}"), re.compile(rf"\b{_SURNAME},{_GAP}{_TITLE}?(?:{some})\b"), re.compile(rf"\b(?:{loud})[^\S\n]+{_UPPER}"),
            re.compile(rf"\b{_UPPER},?[^\S\n]+(?:{some}|{loud})\b"),
        ]

    @staticmethod
    def _flex(name: str) -> re.Pattern | None:
        parts = name.split()
        return re.compile(r"(?<![^\W_])" + r"\s+".join(map(re.escape, parts)) + r"(?![^\W_])") if parts and len(name) > 3 else None

    def spans(self, text: str, own: list[str]) -> list[tuple[int, int, str]]:
        taken: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))

        for kind in ("email", "identity_number", "phone", "address"):
            for form in _COMPILED[kind]:
                for m in form.finditer(text):
                    add(m.start(), m.end(), kind)
        for name in own:
            form = self._flex(name)
            for m in form.finditer(text) if form else ():
                add(m.start(), m.end(), "name")
        for form in self.names:
            for m in form.finditer(text):
                add(m.start(), m.end(), "name")
        for m in _INITIAL.finditer(text):
            if self.ends and m.group().endswith(self.ends):
                add(m.start(), m.end(), "name")
        return sorted(taken)


def own_names(references: list | None, publications: list | None, awards: list | None) -> list[str]:
    """Names that the fields of a row hold. Of those who gave awards only people count: with a title, an initial or a usual given name."""
    out = [q["name"] for q in references or [] if q and q["name"]]
    out += [a for q in publications or [] if q for a in q["authors"] or [] if a and a.strip()]
    for q in awards or []:
        issuer = (q["issuer"] or "").strip() if q else ""
        if issuer and not _ORG.search(issuer) and 2 <= len(issuer.split()) <= 4 and _PERSON.search(issuer):
            out.append(issuer)
    return sorted({n.strip() for n in out}, key=len, reverse=True)


def given_names(rows: list[list[str]]) -> set[str]:
    count: Counter[str] = Counter()
    for own in rows:
        for name in own:
            m = re.fullmatch(rf"({_CAP}) {_SURNAME}", name)
            if m:
                count[m.group(1)] += 1
    found = {g for g, n in count.items() if n >= 5}
    return found | {nick.capitalize() for nicks in NICK.values() for nick in nicks.split() if len(nick) > 1}


_NOISE = {"a": "@", "t": "+", "i": "!", "o": "0", "l": "1", "s": "$", "g": "9", "e": "c"}


def noisy(text: str, rng: np.random.Generator) -> str:
    """A copy of the same length with misread or odd characters."""
    chars = list(text)
    kind = rng.integers(3)
    for i, c in enumerate(chars):
        if rng.random() < 0.06:
            if kind == 0 and c in _NOISE:
                chars[i] = _NOISE[c]
            elif kind == 1 and c.isalpha():
                chars[i] = "\ufffd" if rng.random() < 0.3 or len(c.swapcase()) > 1 else c.swapcase()
            elif kind == 2 and c.isalpha():
                chars[i] = chr(rng.choice([ord(c), 0xC3, 0xA9, 0xE2, 0x200B]))
    return "".join(chars)


#: Plain surroundings, so that items are known by their own form too.
_AROUND = [
    "{} wrote to the board", "I met {} in 2019", "please contact {} for details", "as {} and others said", "signed by {} on Monday", "thanks to {}.", "({})", "see {}; ask first", "Interviewer: {}", "{} lives there", "from {} to the office",
    "reach us under {} at any time", "the records of {} were moved", "He asked {} twice", "our neighbour {}, now retired", "sent to {} last week", "{}", "Written by {}", "on behalf of {}", "My details: {}",
]


def plain_surroundings(texts: list[str], spans: list[list[tuple[int, int, str]]], rng: np.random.Generator, share: float = 0.12) -> list[tuple[str, np.ndarray]]:
    """Some of the items in plain sentences."""
    out = []
    for text, own in zip(texts, spans):
        for a, b, kind in own:
            if rng.random() < share and b - a < 70:
                before, after = _AROUND[rng.integers(len(_AROUND))].split("{}")
                item = " ".join(text[a:b].split())
                whole = before + item + after
                labels = np.zeros(len(whole), dtype=np.int64)
                k = KINDS.index(kind)
                labels[len(before)] = 1 + 2 * k
                labels[len(before) + 1 : len(before) + len(item)] = 2 + 2 * k
                out.append((whole[:WINDOW], labels[:WINDOW]))
    return out


def examples(texts: list[str], spans: list[list[tuple[int, int, str]]]) -> list[tuple[str, np.ndarray]]:
    """Windows of all stretches with the labels of their characters."""
    out = []
    for text, own in zip(texts, spans):
        labels = np.zeros(len(text), dtype=np.int64)
        for a, b, kind in own:
            k = KINDS.index(kind)
            labels[a] = 1 + 2 * k
            labels[a + 1 : b] = 2 + 2 * k
        for a, b, _ in stretches(text):
            at = a
            while at < b:
                end = min(at + WINDOW, b)
                out.append((text[at:end], labels[at:end]))
                at += WINDOW - 32 if end < b else WINDOW
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """The tagger with its gradients."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, e = SIZE, EMBED

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {"emb": normal(VOCABULARY, e, scale=0.3)}
        for side in ("fw", "bw"):
            self.w[f"{side}_x"] = normal(e, 4 * n, scale=1 / e**0.5)
            self.w[f"{side}_h"] = normal(n, 4 * n, scale=1 / n**0.5)
            bias = np.zeros(4 * n, dtype=np.float32)
            bias[n : 2 * n] = 1.0
            self.w[f"{side}_b"] = bias
        self.w |= {"out": normal(2 * n, LABELS, scale=0.2), "out_b": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32), "start": np.zeros(LABELS, np.float32)}
        # the rest of an item can follow only its beginning or itself
        self.banned = np.zeros((LABELS, LABELS), dtype=bool)
        for k in range(len(KINDS)):
            for before in range(LABELS):
                if before not in (1 + 2 * k, 2 + 2 * k):
                    self.banned[before, 2 + 2 * k] = True
        self.w["trans"][self.banned] = -8.0
        self.w["start"][2::2] = -2.0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.step = 0

    def _forward(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        n = SIZE
        steps, width, _ = x.shape
        h, c = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
        gates_in = x @ self.w[f"{side}_x"] + self.w[f"{side}_b"]
        out, kept = np.zeros((steps, width, n), np.float32), []
        for t in range(steps):
            g = gates_in[t] + h @ self.w[f"{side}_h"]
            i, f, o, u = _sigmoid(g[:, :n]), _sigmoid(g[:, n : 2 * n]), _sigmoid(g[:, 2 * n : 3 * n]), np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            new_c = f * c + i * u
            squashed = np.tanh(new_c)
            new_h = o * squashed
            kept.append((i, f, o, u, c, squashed, h))
            c, h = np.where(m, new_c, c), np.where(m, new_h, h)
            out[t] = np.where(m, new_h, 0)
        return out, kept

    def _backward(self, side: str, x: np.ndarray, mask: np.ndarray, kept: list, grad_out: np.ndarray, grads: dict) -> np.ndarray:
        n = SIZE
        steps, width, _ = x.shape
        dh, dc = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
        dg_all = np.zeros((steps, width, 4 * n), np.float32)
        hs = np.zeros((steps, width, n), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, u, c, squashed, h = kept[t]
            m = mask[t][:, None]
            dh_now = (dh + grad_out[t]) * m
            do = dh_now * squashed
            dc_now = dc * m + dh_now * o * (1 - squashed**2)
            dg = np.concatenate([dc_now * u * i * (1 - i), dc_now * c * f * (1 - f), do * o * (1 - o), dc_now * i * (1 - u**2)], axis=1)
            dg_all[t], hs[t] = dg, h
            dh = np.where(m, dg @ self.w[f"{side}_h"].T, dh)
            dc = np.where(m, dc_now * f, dc)
        flat = dg_all.reshape(-1, 4 * n)
        grads[f"{side}_h"] = hs.reshape(-1, n).T @ flat
        grads[f"{side}_x"] = x.reshape(-1, EMBED).T @ flat
        grads[f"{side}_b"] = flat.sum(axis=0)
        return dg_all @ self.w[f"{side}_x"].T

    def train(self, batch: list[tuple[np.ndarray, np.ndarray]], rate: float) -> float:
        """One step of Adam on the CRF's negative log-likelihood; its mean per character."""
        lengths = np.array([len(x) for x, _ in batch])
        steps, width = int(lengths.max()), len(batch)
        ids, gold, mask = np.zeros((steps, width), np.int64), np.zeros((steps, width), np.int64), np.zeros((steps, width), bool)
        back_ids, order = np.zeros((steps, width), np.int64), np.zeros((steps, width), np.int64)
        for j, (x, y) in enumerate(batch):
            k = len(x)
            ids[:k, j], gold[:k, j], mask[:k, j], back_ids[:k, j] = x, y, True, x[::-1]
            order[:k, j] = np.arange(k)[::-1]
            order[k:, j] = np.arange(k, steps)
        columns = np.arange(width)[None, :]
        x, bx = self.w["emb"][ids], self.w["emb"][back_ids]
        fw, fw_kept = self._forward("fw", x, mask)
        bw, bw_kept = self._forward("bw", bx, mask)
        states = np.concatenate([fw, bw[order, columns]], axis=2)
        unary = states @ self.w["out"] + self.w["out_b"]
        trans, start = self.w["trans"], self.w["start"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        alpha = np.zeros((steps, width, LABELS), np.float32)
        alpha[0] = start + unary[0]
        for t in range(1, steps):
            step = lse(alpha[t - 1][:, :, None] + trans, 1) + unary[t]
            alpha[t] = np.where(mask[t][:, None], step, alpha[t - 1])
        total = lse(alpha[-1], 1)
        beta = np.zeros((steps, width, LABELS), np.float32)
        d_trans = np.zeros_like(trans)
        for t in range(steps - 2, -1, -1):
            ahead = trans + (unary[t + 1] + beta[t + 1])[:, None, :]
            beta[t] = np.where(mask[t + 1][:, None], lse(ahead, 2), beta[t + 1])
            pair = np.exp(alpha[t][:, :, None] + ahead - total[:, None, None]) * mask[t + 1][:, None, None]
            d_trans += pair.sum(axis=0)
        d_unary = np.exp(alpha + beta - total[None, :, None]) * mask[:, :, None]
        d_start = d_unary[0].sum(axis=0)
        rows = np.arange(width)
        score = start[gold[0]] + unary[0, rows, gold[0]]
        np.add.at(d_start, gold[0], -1)
        for t in range(1, steps):
            m = mask[t]
            score = score + np.where(m, trans[gold[t - 1], gold[t]] + unary[t, rows, gold[t]], 0)
            np.add.at(d_trans, (gold[t - 1][m], gold[t][m]), -1)
        tt, jj = np.nonzero(mask)
        d_unary[tt, jj, gold[tt, jj]] -= 1
        count = float(mask.sum())
        grads: dict[str, np.ndarray] = {"trans": d_trans, "start": d_start, "out": states.reshape(-1, 2 * SIZE).T @ d_unary.reshape(-1, LABELS), "out_b": d_unary.sum(axis=(0, 1))}
        d_states = d_unary @ self.w["out"].T
        d_x = self._backward("fw", x, mask, fw_kept, d_states[:, :, :SIZE], grads)
        d_bw = np.zeros_like(bw)
        d_bw[order, columns] = d_states[:, :, SIZE:]
        d_bx = self._backward("bw", bx, mask, bw_kept, d_bw, grads)
        d_emb = np.zeros_like(self.w["emb"])
        np.add.at(d_emb, ids.ravel(), (d_x * mask[:, :, None]).reshape(-1, EMBED))
        np.add.at(d_emb, back_ids.ravel(), (d_bx * mask[:, :, None]).reshape(-1, EMBED))
        grads["emb"] = d_emb
        grads["trans"][self.banned] = 0
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values()))) / width
        scale = (1.0 if norm < 5 else 5 / norm) / width
        self.step += 1
        for k, g in grads.items():
            g = g * scale
            m, v = self.moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.w[k] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
        return float((total - score).sum()) / count


def fit(rows: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 5, log: bool = False, rate: float = RATE, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights from (text, names of the row's own fields), of ``SAMPLE`` rows at most; ``start`` has weights to go on from.

    An epoch has the windows with items, those without one whose turn it is, and those in
    which the network finds some all the same.
    """
    rows = rows[:SAMPLE]
    own = [names for _, names in rows]
    labeller = Labeller(given_names(own), surnames_of(own))
    texts = [t for t, _ in rows]
    spans = [labeller.spans(t, own) for t, own in rows]
    rng = np.random.default_rng(seed)
    windows = examples(texts, spans)
    held = [x for x in windows if x[1].any()] + plain_surroundings(texts, spans, rng)
    bare = [x for x in windows if not x[1].any()]
    net = Network(seed)
    if start:
        net.w |= {k: start[k].astype(np.float32) for k in net.w}
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs) + 0.0004
        wrong = {k for k, y in enumerate(Tagger(net.w).label([t for t, _ in bare])) if y.any()} if epoch or start else set()
        data = held + [bare[k] for k in range(len(bare)) if k % TURNS == epoch % TURNS or k in wrong]
        data = [data[k] for k in rng.permutation(len(data))]
        data.sort(key=lambda x: len(x[0]))
        batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
        losses = []
        for b in rng.permutation(len(batches)):
            batch = [(char_ids(noisy(t, rng) if rng.random() < 0.12 else t).astype(np.int64), y) for t, y in batches[b]]
            losses.append(net.train(batch, now))
        if log:
            print(f"epoch {epoch}: {np.mean(losses):.5f} over {len(data)} of {len(held) + len(bare)} windows, {len(wrong)} wrong", flush=True)
    return {k: v.astype(np.float16) for k, v in net.w.items()}


def main(path: str, on: bool = False) -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(path, columns=["doc_id", "raw_text", "reference_items", "publications", "awards"]).sort_by("doc_id").to_pylist()
    rows = [(r["raw_text"], own_names(r["reference_items"], r["publications"], r["awards"])) for r in table if r["raw_text"]]
    # mail and phone fields are short stretches of their own
    for r in table:
        for q in r["reference_items"] or []:
            for field in ("email", "phone"):
                if q and q[field] and q[field].strip():
                    rows.append((q[field], [q["name"]] if q["name"] else []))
    texts = [r for r in rows if "\n" in r[0]][: SAMPLE * 3 // 4]
    fields = [r for r in rows if "\n" not in r[0]][: SAMPLE // 4]
    weights = fit(texts + fields, MORE, log=True, rate=RATE / 2, start=load()) if on else fit(texts + fields, log=True)
    np.savez_compressed(MODEL, **weights)


if __name__ == "__main__":
    main(sys.argv[1], "--on" in sys.argv)
