"""Personal information in free text: a skip-chain conditional random field with loopy message passing, applied in batches."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.llm.pii_text import GIVEN, LABELS, STREET_AFTER, STREET_BEFORE, STREET_JOINED, UNITS, Writer
from tessella.plans.materialize import discard, materialize

#: A token takes the white space before it along, so its type knows what it is glued to.
TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)|\s+$")
SLOTS = 1 << 18
REACH = (-3, -2, -1, 0, 1, 2, 3)
#: Chains longer than this are cut into windows that overlap by MARGIN tokens on both sides; every token is labelled once.
WINDOW, MARGIN = 256, 24
ROUNDS = 3
_MASK = np.uint64(SLOTS - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bare(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _slot(text: str) -> int:
    return (zlib.crc32(text.encode()) % (SLOTS - 1)) + 1


class _Ids(dict):
    def __init__(self, make):
        super().__init__({"": 0})
        self.make = make

    def __missing__(self, token: str) -> int:
        return self.make(token)


class Types:
    """Features of distinct tokens, computed once for each."""

    def __init__(self, known: frozenset[str], brands: frozenset[str]):
        self.known, self.brands = known, brands
        self.cut = frozenset(w[:-1] for w in known if len(w) > 4)
        self.given = frozenset(map(_bare, GIVEN))
        self.street = frozenset(s.lower().strip(".") for s in [*STREET_AFTER, *[w for b in STREET_BEFORE for w in b.split()]]) - {"de", "du"}
        self.units = frozenset(u.lower().strip(".") for u in UNITS)
        self.joined = tuple(STREET_JOINED)
        self.ids = _Ids(self._new)
        self.codes = [0]
        self.features: list[list[list[int]]] = [[[_slot(f"{k}|edge")] for k in REACH]]
        self.linked: list[int] = [0]

    def _typo(self, w: str) -> bool:
        if w in self.cut or w[1:] in self.known or w[:-1] in self.known:
            return True
        return any(w[:i] + w[i + 1] + w[i] + w[i + 2 :] in self.known for i in range(len(w) - 1)) if len(w) < 25 else False

    def _new(self, token: str) -> int:
        core = token.lstrip()
        gap = token[: len(token) - len(core)]
        glue = "n" if "\n" in gap else "s" if gap else "g"
        low = core.lower()
        more: list[str] = []
        link = 0
        if not core:
            word = cls = "blank"
        elif core.isdigit():
            word = cls = f"d{min(len(core), 14)}"
            more = [f"lead{core[0]}"]
            if len(core) > 3:
                link = zlib.crc32(core.encode()) | 1
        elif core[0].isalpha():
            case = "l" if core == low else "T" if core[1:] == low[1:] and len(core) > 1 else "U" if core == core.upper() else "M"
            kind = "given" if _bare(low) in self.given else "way" if low in self.street else "unit" if low in self.units else "brand" if low in self.brands else "known" if low in self.known else "one" if len(low) < 3 else "typo" if self._typo(low) else "rare"
            cls = f"{kind}{case}{min(len(core), 3) if kind == 'one' else ''}"
            word = low if kind in ("way", "unit", "brand", "known", "one") else kind
            if kind in ("rare", "typo", "given"):
                more = [f"e3{low[-3:]}", f"e2{low[-2:]}", f"e4{low[-4:]}", f"b2{low[:2]}", f"len{min(len(low), 12)}"]
                if low.endswith(self.joined):
                    more.append("joined")
                    cls += "j"
            if kind in ("rare", "given"):
                link = zlib.crc32(low.encode()) | 1
        else:
            word = cls = core
        cls += glue
        rows = []
        for k in REACH:
            names = [f"w{word}"]
            if abs(k) < 3:
                names.append(f"c{cls}")
            if k == 0:
                names += [f"wc{word}{cls}", *more]
            rows.append([_slot(f"{k}|{n}") for n in names])
        self.ids[token] = i = len(self.codes)
        self.codes.append(zlib.crc32(cls.encode()) + 1)
        self.features.append(rows)
        self.linked.append(link)
        return i


def _patterns(codes: np.ndarray) -> np.ndarray:
    """Slots of the joint features of neighbouring token classes, five a token; ``codes`` is padded by two on both sides."""
    a, b, c, d, e = (codes[i : len(codes) - 4 + i] for i in range(5))
    x, y, z = _MIX
    five = (a * x + b) * y + c
    with np.errstate(over="ignore"):
        joint = [b * x + c * y, c * x + d * z, (b * x + c) * y + d * z, (a * y + b) * z + c * x, ((five * z + d) * x + e) * y]
    out = np.stack([((j ^ (j >> np.uint64(29))) * x >> np.uint64(20)) & _MASK for j in joint], axis=1)
    return out.astype(np.int64)


class Batch:
    """The tokens of many texts in one array, cut into windows."""

    def __init__(self, texts: list[str], types: Types):
        get = types.ids.__getitem__
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        self.tokens: list[list[str]] = []
        for n, t in enumerate(texts):
            found = TOKEN.findall(t)
            self.tokens.append(found)
            sizes[n] = len(found)
            flat.extend(map(get, found))
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.type = np.array(flat, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.links = self._links(np.array(types.linked, np.uint64)) if flat else np.zeros((0, 2), np.int64)
        self.windows = self._windows(sizes)

    def near(self, k: int) -> np.ndarray:
        """The type ``k`` tokens further on in the same text, 0 past its ends."""
        at = np.arange(len(self.type)) + k
        inside = (at >= 0) & (at < len(self.type))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.doc[at] == self.doc), self.type[at], 0)

    def _links(self, linked: np.ndarray) -> np.ndarray:
        """Skip edges: each repeated or, but for case, equal telling token with its next occurrence in the text."""
        code = linked[self.type]
        at = np.flatnonzero(code)
        order = at[np.lexsort((at, code[at], self.doc[at]))]
        same = (code[order][1:] == code[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        return np.stack([order[:-1][same], order[1:][same]], axis=1)

    def _windows(self, sizes: np.ndarray) -> np.ndarray:
        """(first, length, first kept, kept) of each window."""
        if len(sizes) == 0:
            return np.zeros((0, 4), np.int64)
        short = (sizes > 0) & (sizes <= WINDOW)
        first = self.start[:-1][short]
        out = [np.stack([first, sizes[short], first, sizes[short]], axis=1)]
        for n in np.flatnonzero(sizes > WINDOW):
            for at in range(0, sizes[n], WINDOW - 2 * MARGIN):
                a, b = max(0, at - MARGIN), min(sizes[n], at + WINDOW - MARGIN)
                end = min(sizes[n], at + WINDOW - 2 * MARGIN)
                out.append(np.array([[self.start[n] + a, b - a, self.start[n] + at, end - at]]))
        return np.concatenate(out)


class Tagger:
    """The field's weights: hashed features of a token and its neighbours, transitions, and skip edges for each label."""

    def __init__(self, known: frozenset[str], brands: frozenset[str]):
        self.known, self.brands = known, brands
        k = len(LABELS)
        self.w = np.zeros((SLOTS, k), np.float32)
        self.moves = np.zeros((k, k), np.float32)
        self.first = np.zeros(k, np.float32)
        self.last = np.zeros(k, np.float32)
        self.skip = np.zeros(k, np.float32)
        self.types = Types(known, brands)
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"known": self.known, "brands": self.brands} | {n: getattr(self, n).astype(np.float16) for n in ("w", "moves", "first", "last", "skip")}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["known"], state["brands"])
        for n in ("w", "moves", "first", "last", "skip"):
            setattr(self, n, state[n].astype(np.float32))

    # --- scores ---

    def _grow(self) -> None:
        """Per-type score tables, one for each neighbour's place, for types not seen before."""
        have = 0 if self._tables is None else len(self._tables[0])
        fresh = [[self.w[rows[k]].sum(axis=0) for rows in self.types.features[have:]] for k in range(len(REACH))]
        blocks = [np.array(f, np.float32).reshape(-1, len(LABELS)) for f in fresh]
        self._tables = blocks if self._tables is None else [np.concatenate([t, b]) if len(b) else t for t, b in zip(self._tables, blocks)]

    def _codes(self, batch: Batch) -> np.ndarray:
        """Class codes with two edge tokens between texts, and the place of each token in them."""
        code = np.array(self.types.codes, np.uint64)
        place = np.arange(len(batch.type)) + 2 * batch.doc + 2
        out = np.zeros(len(batch.type) + 2 * len(batch.start) + 4, np.uint64)
        out[place] = code[batch.type]
        return out, place

    def patterns(self, batch: Batch) -> np.ndarray:
        codes, place = self._codes(batch)
        return _patterns(codes)[place - 2]

    def scores(self, batch: Batch) -> np.ndarray:
        self._grow()
        total = np.zeros((len(batch.type), len(LABELS)), np.float32)
        for k, t in zip(REACH, self._tables):
            total += t[batch.near(k)]
        p = self.patterns(batch)
        for i in range(p.shape[1]):
            total += self.w[p[:, i]]
        return total

    # --- inference ---

    def _chains(self, scores: np.ndarray, windows: np.ndarray, want_pairs: bool = False):
        """Marginals of every token of the windows by forward and backward messages along their chains."""
        k = len(LABELS)
        marginal = np.zeros((len(scores), k), np.float32)
        pairs = np.zeros((k, k))
        move = np.exp(self.moves)
        order = windows[np.argsort(-windows[:, 1], kind="stable")]
        for lo in range(0, len(order), 2048):
            block = order[lo : lo + 2048]
            n, longest = len(block), int(block[0, 1])
            at = block[:, 0][:, None] + np.arange(longest)
            inside = np.arange(longest) < block[:, 1][:, None]
            s = scores[np.where(inside, at, 0)]
            top = s.max(axis=2, keepdims=True)
            e = np.exp(np.maximum(s - top, -30.0))
            live = inside.sum(axis=0)
            alpha = np.zeros((longest, n, k), np.float32)
            beta = np.zeros((longest, n, k), np.float32)
            a = e[:, 0] * np.exp(self.first)
            alpha[0] = a / a.sum(axis=1, keepdims=True)
            for t in range(1, longest):
                m = live[t]
                a = (alpha[t - 1, :m] @ move) * e[:m, t]
                a /= a.sum(axis=1, keepdims=True)
                alpha[t, :m] = a
            end = np.exp(self.last)
            for t in range(longest - 1, -1, -1):
                m = live[t]
                beta[t, :m] = end
                if t + 1 < longest and (q := live[t + 1]):
                    ahead = e[:q, t + 1] * beta[t + 1, :q]
                    b = ahead @ move.T
                    b /= b.sum(axis=1, keepdims=True)
                    beta[t, :q] = b
                    if want_pairs:
                        x = alpha[t, :q, :, None] * move * ahead[:, None, :]
                        pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            post = (alpha * beta).transpose(1, 0, 2)
            post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-30)
            kept = inside & (at >= block[:, 2][:, None]) & (at < (block[:, 2] + block[:, 3])[:, None])
            marginal[at[kept]] = post[kept]
        return marginal, pairs

    def marginals(self, batch: Batch, want_pairs: bool = False):
        """Beliefs of every token: exact along chains, and passed over skip edges for ROUNDS rounds where a text has any."""
        scores = self.scores(batch)
        belief, pairs = self._chains(scores, batch.windows, want_pairs)
        if len(batch.links) == 0:
            return belief, pairs, np.zeros(len(LABELS))
        docs = np.zeros(len(batch.start), bool)
        docs[batch.doc[batch.links[:, 0]]] = True
        windows = batch.windows[docs[batch.doc[batch.windows[:, 0]]]]
        i, j = batch.links[:, 0], batch.links[:, 1]
        tie = np.ones((len(LABELS), len(LABELS)), np.float32)
        np.fill_diagonal(tie, np.exp(self.skip))
        to_j = np.full((len(i), len(LABELS)), 1.0 / len(LABELS), np.float32)
        to_i = to_j.copy()
        for _ in range(ROUNDS):
            from_i, from_j = belief[i] / np.maximum(to_i, 1e-6), belief[j] / np.maximum(to_j, 1e-6)
            to_j, to_i = from_i @ tie, from_j @ tie
            to_j /= to_j.sum(axis=1, keepdims=True)
            to_i /= to_i.sum(axis=1, keepdims=True)
            heard = scores.copy()
            np.add.at(heard, j, np.log(to_j + 1e-6))
            np.add.at(heard, i, np.log(to_i + 1e-6))
            again, _ = self._chains(heard, windows)
            mine = docs[batch.doc]
            belief = np.where(mine[:, None], again, belief)
        both = (belief[i] / np.maximum(to_i, 1e-6)) * (belief[j] / np.maximum(to_j, 1e-6)) * np.exp(self.skip)
        other = (belief[i] / np.maximum(to_i, 1e-6)).sum(axis=1) * (belief[j] / np.maximum(to_j, 1e-6)).sum(axis=1)
        plain = ((belief[i] / np.maximum(to_i, 1e-6)) * (belief[j] / np.maximum(to_j, 1e-6))).sum(axis=1)
        agree = (both / (other - plain + both.sum(axis=1))[:, None]).sum(axis=0)
        return belief, pairs, agree

    # --- training ---

    def fit(self, texts: list[tuple[str, list[tuple[int, int, int]]]], epochs: int, rate: float = 0.2, decay: float = 1e-6) -> "Tagger":
        """Maximum likelihood by adaptive gradient steps over batches of texts with labelled character spans."""
        k = len(LABELS)
        grown = {n: np.full_like(getattr(self, n), 1e-6) for n in ("w", "moves", "first", "last", "skip")}
        ready = []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            batch = Batch([t for t, _ in part], self.types)
            gold = np.zeros(len(batch.type), np.int64)
            for n, (_, spans) in enumerate(part):
                at, place = 0, batch.start[n]
                for token in batch.tokens[n]:
                    middle = at + len(token) - 1
                    at += len(token)
                    for a, b, label in spans:
                        if a <= middle < b:
                            gold[place] = label
                    place += 1
            ready.append((batch, gold))
        widest = [max(len(rows[i]) for rows in self.types.features) for i in range(len(REACH))]
        padded = []
        for i, wide in enumerate(widest):
            table = np.zeros((len(self.types.features), wide), np.int64)
            for t, rows in enumerate(self.types.features):
                table[t, : len(rows[i])] = rows[i]
            padded.append(table)
        slots = [np.concatenate([*[p[b.near(o)] for o, p in zip(REACH, padded)], self.patterns(b)], axis=1) for b, _ in ready]
        shuffler = np.random.default_rng(7)
        for epoch in range(epochs):
            for n in shuffler.permutation(len(ready)):
                batch, gold = ready[n]
                self.scores = lambda _b, s=slots[n]: self.w[s].sum(axis=1)  # the tables would change with every step
                belief, pairs, agree = self.marginals(batch, True)
                hot = np.zeros_like(belief)
                hot[np.arange(len(gold)), gold] = 1
                diff = hot - belief
                where, inverse = np.unique(slots[n].ravel(), return_inverse=True)
                wide = slots[n].shape[1]
                g = np.stack([np.bincount(inverse, np.repeat(diff[:, c], wide), len(where)) for c in range(k)], axis=1).astype(np.float32)
                g[where == 0] = 0
                g -= decay * len(gold) * self.w[where]
                self._step("w", g, grown, rate, where)
                inner = np.flatnonzero(batch.doc[1:] == batch.doc[:-1])
                seen = np.zeros((k, k))
                np.add.at(seen, (gold[inner], gold[inner + 1]), 1)
                self._step("moves", (seen - pairs).astype(np.float32), grown, rate)
                full = batch.start[:-1] < batch.start[1:]
                self._step("first", diff[batch.start[:-1][full]].sum(axis=0), grown, rate)
                self._step("last", diff[batch.start[1:][full] - 1].sum(axis=0), grown, rate)
                if len(batch.links):
                    i, j = gold[batch.links[:, 0]], gold[batch.links[:, 1]]
                    same = np.bincount(i[i == j], minlength=k)
                    self._step("skip", (same - agree).astype(np.float32), grown, rate)
            rate *= 0.8
        del self.scores
        self._tables = None
        return self

    def _step(self, name: str, g: np.ndarray, grown: dict, rate: float, where=slice(None)) -> None:
        grown[name][where] += g * g
        getattr(self, name)[where] += rate * g / np.sqrt(grown[name][where])

    # --- use ---

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, label) of every value in each text, in order; a value must have the parts that its type needs."""
        batch = Batch(texts, self.types)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if len(batch.type) == 0:
            return out
        label = self.marginals(batch)[0].argmax(axis=1)
        hits = np.flatnonzero(label)
        for n in np.unique(batch.doc[hits]):
            at, run = 0, None
            lo = batch.start[n]
            for i, token in enumerate(batch.tokens[n]):
                kind = label[lo + i]
                begin = at + len(token) - len(token.lstrip())
                at += len(token)
                if run and run[2] == kind:
                    run[1] = at
                elif kind:
                    run = [begin, at, int(kind)]
                    out[n].append(run)
                else:
                    run = None
            out[n] = [r for r in joined(out[n], texts[n]) if complete(texts[n][r[0] : r[1]], r[2])]
        return out


def joined(runs: list[list[int]], text: str) -> list[tuple[int, int, int]]:
    """The values of a text, a name that runs into an e-mail address being the beginning of it."""
    out: list[tuple[int, int, int]] = []
    for lo, hi, label in runs:
        if out and label == 1 and out[-1][2] in (1, 5) and text[out[-1][1] : lo].strip() in ("", "@", "_", ".", "-", "+") and re.match(r"[@_.+\-\[(]|at\b", text[out[-1][1] : hi].lstrip(), re.I):
            out[-1] = (out[-1][0], hi, 1)
        elif label == 5 and re.match(r"[\w.+\-]*(@|\s?[\[(](at|@)[\])])", text[hi : hi + 40], re.I):
            out.append((lo, hi, 1))
        else:
            out.append((lo, hi, label))
    return out


def complete(value: str, label: int) -> bool:
    """Whether a value has what no value of its type can lack."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    return {
        1: bool(re.search(r"@|\bat\b", value, re.I)) and letters > 3,
        2: digits >= 7,
        3: digits >= 5,
        4: digits >= 1 and letters > 3,
        5: letters > 1,
    }[label]


_BREAK = re.compile(r"<br ?/?>")
_WORD = re.compile(r"[^\W\d_]+")
#: Numbers of three digits, or of five in groups, and signs of addresses: no sentence with these goes unlabelled into training.
_ADDRESS = re.compile(r"\d{3}|\d(?:[ .()/\-]{0,2}\d){4}|@|\(at\)")
_personal = frozenset(g.lower() for g in GIVEN) | {"mrs", "mr", "dr", "ssn", "passport"}


def _pieces(text: str) -> list[str]:
    """A text cut at line breaks, before <br> and after sentences. Its words are the words of the pieces."""
    return text.replace("<br", "\n<br").replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")


class Language:
    """Counts of texts and words, and the ``draw`` distinct ordinary sentences of least hashes: an even draw from those of all
    texts added. Ordinary is what has no long numbers, signs of addresses, given names or titles. Equal pieces are read once;
    memory is bounded where ``words`` is emptied in time."""

    def __init__(self, draw: int):
        self.draw, self.texts, self.bound = draw, 0, 1 << 32
        self.words: Counter[str] = Counter()
        self.drawn: dict[str, int] = {}
        self.pieces: Counter[str] = Counter()

    def add(self, texts: list[str]) -> None:
        self.texts += len(texts)
        for t in texts:
            self.pieces.update(_pieces(t))
            if len(self.pieces) > 100_000:
                self.settle()

    def settle(self) -> None:
        """Count the pieces that wait."""
        by_count: dict[int, list[str]] = {}
        for p, n in self.pieces.items():
            by_count.setdefault(n, []).append(p)
        for n, pieces in by_count.items():
            for w, m in Counter(_WORD.findall("\n".join(pieces).lower())).items():
                self.words[w] += n * m
        bare = {(_BREAK.sub("", p) if p[:1] == "<" else p).strip() for p in self.pieces}
        self.pieces.clear()
        places = sorted((h, s) for s in bare if len(s) > 8 and (h := zlib.crc32(s.encode())) < self.bound and s not in self.drawn)
        fresh = 0
        for h, s in places:
            if fresh == self.draw:
                break
            if not _ADDRESS.search(s) and _personal.isdisjoint(_WORD.findall(s.lower())):
                self.drawn[s] = h
                fresh += 1
        if len(self.drawn) > self.draw:
            least = sorted(self.drawn.items(), key=lambda x: (x[1], x[0]))[: self.draw]
            self.drawn, self.bound = dict(least), least[-1][1] + 1


def _fitted(known: frozenset[str], sentences: list[str], brands: list[str], written: int, epochs: int, seed: int) -> Tagger:
    plain = sorted(s for s in sentences if all(w in known for w in _WORD.findall(s.lower())))
    marks = frozenset(w for b in brands for w in _WORD.findall(b.lower()) if w not in {"and", "the", "co", "lab", "skin"})
    writer = Writer(seed, plain, brands)
    tagger = Tagger(known | frozenset(w.lower() for w in writer.words), marks)
    return tagger.fit([writer.text() for _ in range(written)], epochs)


def train(texts: list[str], brands: list[str], written: int = 8000, epochs: int = 5, seed: int = 5, frequent: int = 5) -> Tagger:
    """A tagger for the language of ``texts``: their words with at least ``frequent`` occurrences are the known vocabulary,
    and their sentences of such words alone, without long numbers or signs of addresses, are the ordinary surroundings of
    ``written`` generated texts. ``brands`` are names that are no persons."""
    language = Language(2 * written)
    language.add(texts)
    language.settle()
    return _fitted(frozenset(w for w, n in language.words.items() if n >= frequent), list(language.drawn), brands, written, epochs, seed)


def _language(docs: DataFrame, text: str, draw: int, frequent: int, per_texts: int) -> tuple[int, frozenset[str], list[str]]:
    """The number of all texts, their words with at least ``frequent`` occurrences in ``per_texts`` texts (or in all, if there are
    fewer), and ``draw`` of their ordinary sentences. Every text is read; a share keeps the vocabulary's size as texts grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = Language(draw)

        def rows(items: list[str], counts: list[int] | None, places: list[int] | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(counts or [None] * len(items), pa.int64()), pa.array(places or [None] * len(items), pa.int64())], ["item", "n", "place"])

        for b in batches:
            language.add(b.column(0).to_pylist())
            if len(language.words) > 200_000:
                yield rows(list(language.words), list(language.words.values()), None)
                language.words.clear()
        language.settle()
        yield rows(["", *language.words], [language.texts, *language.words.values()], None)
        yield rows(list(language.drawn), None, list(language.drawn.values()))

    found = materialize(docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "item string, n long, place long"), "language")
    texts = found.where("item = '' and n is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = found.where("item <> '' and n is not null").groupBy("item").agg(F.sum("n").alias("n"))
    known = frozenset(r[0] for r in counts.where(F.col("n") * per_texts >= frequent * max(texts, per_texts)).select("item").collect())
    places = found.where("place is not null").select("place", "item").distinct()
    bound, ahead = 1 << 32, 0
    for part, n in sorted(places.groupBy(F.shiftright("place", 16)).count().collect()):  # the driver only gets what it keeps, and one part in 65,536
        ahead += n
        if ahead >= draw:
            bound = (part + 1) << 16
            break
    sentences = [s for _, s in sorted((r["place"], r["item"]) for r in places.where(F.col("place") < bound).collect())[:draw]]
    discard(found)
    return texts, known, sentences


def _names(docs: DataFrame, column: str, over: int) -> list[str]:
    """The values of a column that more than ``over`` rows hold, but for spacing, the most frequent first."""
    counts = docs.where(F.col(column).isNotNull()).groupBy(strip(F.regexp_replace(column, r"(?U)\s+", " ")).alias("name")).count()
    return [r["name"] for r in sorted(counts.where(F.col("count") > over).collect(), key=lambda r: (-r["count"], r["name"]))]


def tag(docs: DataFrame, doc_id: str, text: str, tagger: Tagger) -> DataFrame:
    """(doc_id, types, masked) of every document with personal information: the types found and the whole text with typed
    placeholders. Null and empty texts hold none."""
    ship = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ship.value
        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys, types, masked = [], [], []
            for i, t, spans in zip(ids, values, model.spans(values)):
                if not spans:
                    continue
                out, at = [], 0
                for lo, hi, label in spans:
                    out += [t[at:lo], f"[{LABELS[label].upper()}]"]
                    at = hi
                keys.append(i)
                types.append(sorted({LABELS[s[2]] for s in spans}))
                masked.append("".join(out) + t[at:])
            if len(model.types.ids) > 400_000:  # rare tokens would fill the memory; features are made anew
                model.types, model._tables = Types(model.known, model.brands), None
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(types, pa.list_(pa.string())), pa.array(masked, pa.string())], ["doc_id", "types", "masked"])

    slim = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, types array<string>, masked string").withColumnRenamed("doc_id", doc_id)


def personal_information(
    docs: DataFrame, doc_id: str, text: str, brand: str | None = None, written: int = 8000, epochs: int = 5, seed: int = 5, frequent: int = 5, per_texts: int = 20_000
) -> DataFrame:
    """``tag`` by a tagger trained on generated values among the language of all texts: as ``train``, but the known vocabulary has
    ``frequent`` occurrences in ``per_texts`` texts, and brands are the values of more than one in 2,000 rows."""
    texts, known, sentences = _language(docs, text, 2 * written, frequent, per_texts)
    brands = _names(docs, brand, max(2, texts // 2000)) if brand else []
    return tag(docs, doc_id, text, _fitted(known, sentences, brands, written, epochs, seed))
