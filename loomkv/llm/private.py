"""op3: personal data and secrets in every document, by a semi-Markov conditional random field.

A text is cut at white space into chunks, and runs of chunks with a digit or @ ("islands") into tokens:
runs of letters and digits, and single marks. Dynamic programming picks the best sequence of segments
over an island: a token of no kind, or up to MOST_TOKENS tokens of one kind, scored as a whole by the
features of the span and by the kind before it; so boundaries and kinds are chosen together. A segment of
a kind never leaves its island, holds a digit or @ and ends in a letter or digit, so that tokens outside
islands can only be of no kind, and the islands of a text are independent: the result is that of the whole text.

The weights are learned on TRAIN_ISLANDS seeded examples, by the exact gradient of their log-likelihood.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm import text as T

KINDS = ("", "EMAIL", "PHONE", "CARD", "IP", "SECRET")
MOST_TOKENS = 12
BUCKETS = 1 << 12
TRAIN_ISLANDS = 300
ROUNDS = 40
RATE = 0.5
L2 = 1e-3
REMEMBER = 100_000
SLICE = 1 << 22
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
SECRET_WORDS = {"token", "key", "secret", "password", "passwd", "apikey", "auth", "bearer"}
HEX = re.compile(r"(?=.*[0-9])[0-9a-fA-F]{16,}|(?=.*[0-9])(?=.*[a-zA-Z])[0-9a-zA-Z]{24,}")
INSIDE = re.compile(r"[dwh](?:[._+-]?[dwh])*")
TRIGGER = np.zeros(256, bool)
TRIGGER[[*range(48, 58), 64]] = True
NEVER = -1e30


def shape(token: str) -> str:
    """The token's class: d with the number of digits (o: at most 255), h a long mix, a letters, w letters and digits, or the mark itself."""
    if token.isdigit():
        return f"d{min(len(token), 20)}" + "o" * (len(token) <= 3 and token.isascii() and int(token) <= 255)
    if token.isalnum():
        return "h" if HEX.fullmatch(token) else "a" if token.isalpha() else "w"
    return token


def _features(shapes: list[str], gaps: list[bool], context: str, i: int, j: int) -> list[int]:
    """Buckets of the features of the whole span of tokens i to j - 1."""
    own = shapes[i:j]
    plain = "".join((" " if gaps[k] and k > i else "") + ("d" if s[0] == "d" and len(s) > 1 else "h" if s == "h" else "w" if s in ("a", "w") else s) for k, s in enumerate(own, i))
    exact = "".join((" " if gaps[k] and k > i else "") + s.rstrip("o") for k, s in enumerate(own, i))
    digits = sum(int(s[1:].rstrip("o")) for s in own if s[0] == "d" and len(s) > 1)
    marks = "".join(s for s in own if not s[0].isalnum())
    octets = sum(s.endswith("o") and s[0] == "d" for s in own)
    left = "^" if i == 0 or gaps[i] else shapes[i - 1][0]
    right = "$" if j == len(shapes) or gaps[j] else shapes[j][0] + ("$" if j + 1 == len(shapes) or gaps[j + 1] else "+")
    kind = INSIDE.sub("W", plain) if "@" in plain else plain
    names = ("", f"e{exact}", f"k{kind}", f"n{digits}|{marks}", f"m{marks}", f"o{octets}|{j - i}", f"l{left}|{kind}", f"r{right}|{kind}", f"c{context}|{plain}", f"t{j - i}|{min(digits, 8)}")
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


class Island:
    """Its segments in order of their end: first and last token (one past), features, and whether they may be of a kind or of none."""

    def __init__(self, text: str, context: str = "") -> None:
        self.tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        words = [text[a:b] for a, b in self.tokens]
        gaps = [k > 0 and self.tokens[k - 1][1] != a for k, (a, _) in enumerate(self.tokens)]
        self.key = (context, *((s, g) for s, g in zip(map(shape, words), gaps)))
        self.n = len(words)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j) of each segment, its features, and which kinds it may have."""
        context, *rest = self.key
        shapes, gaps = [s for s, _ in rest], [g for _, g in rest]
        hot = [0]
        for s in shapes:
            hot.append(hot[-1] + (s == "@" or s == "h" or s == "w" or (s[0] == "d" and len(s) > 1)))
        ends = [s[0].isalnum() for s in shapes]
        spans, features, allowed = [], [], []
        for j in range(1, self.n + 1):
            for i in range(max(0, j - MOST_TOKENS), j):
                kind = ends[j - 1] and (ends[i] or shapes[i] in "+(") and hot[j] > hot[i]
                if kind or i == j - 1:
                    spans.append((i, j))
                    features.append(_features(shapes, gaps, context, i, j))
                    allowed.append([i == j - 1] + [kind] * (len(KINDS) - 1))
        return np.array(spans).reshape(-1, 2), np.array(features).reshape(len(spans), -1), np.array(allowed, bool).reshape(-1, len(KINDS))


def scores(model: tuple[np.ndarray, np.ndarray], features: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    return np.where(allowed, model[0][features].sum(1), NEVER)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def forward(n: int, spans: np.ndarray, s: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all ways to cover the first j tokens that end in kind k; before the first token stands no kind."""
    alpha = np.full((n + 1, len(KINDS)), NEVER)
    alpha[0, 0] = 0
    cut = np.searchsorted(spans[:, 1], np.arange(n + 2))
    for j in range(1, n + 1):
        here = slice(cut[j], cut[j + 1])
        alpha[j] = _log_sum(_log_sum(alpha[spans[here, 0]][:, :, None] + follow, 1) + s[here], 0)
    return alpha


def backward(n: int, spans: np.ndarray, s: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all ways to cover the tokens from i on, after kind k."""
    beta = np.full((n + 1, len(KINDS)), NEVER)
    beta[n] = 0
    order = np.argsort(spans[:, 0], kind="stable")
    cut = np.searchsorted(spans[order, 0], np.arange(n + 2))
    for i in reversed(range(n)):
        here = order[cut[i] : cut[i + 1]]
        beta[i] = _log_sum(_log_sum(follow + (s[here] + beta[spans[here, 1]])[:, None, :], 2), 0)
    return beta


def truth(spans: np.ndarray, gold: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """(segment, kind) of the right sequence: the gold segments, and no kind for the other tokens."""
    covered = {t for i, j in gold for t in range(i, j)}
    kinds = [(i, k, gold.get((i, j), 0 if j == i + 1 and i not in covered else -1)) for k, (i, j) in enumerate(spans.tolist())]
    return [(k, kind) for _, k, kind in sorted(kinds) if kind >= 0]


def gradient(n: int, spans: np.ndarray, s: np.ndarray, follow: np.ndarray, right: list[tuple[int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the right sequence, and its gradient by s and by follow."""
    alpha, beta = forward(n, spans, s, follow), backward(n, spans, s, follow)
    z = _log_sum(alpha[n], 0)
    pairs = np.exp(np.minimum(alpha[spans[:, 0]][:, :, None] + follow + (s + beta[spans[:, 1]])[:, None, :] - z, 0))
    by_span, by_follow, total, before = -pairs.sum(1), -pairs.sum(0), 0.0, 0
    for k, kind in right:
        by_span[k, kind] += 1
        by_follow[before, kind] += 1
        total += s[k, kind] + follow[before, kind]
        before = kind
    return total - z, by_span, by_follow


def best(model: tuple[np.ndarray, np.ndarray], n: int, spans: np.ndarray, features: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, one past the last, kind) of the segments of kinds in the best sequence; ties go to the earlier kind, then to the longer segment."""
    s, follow = scores(model, features, allowed), model[1]
    value = np.full((n + 1, len(KINDS)), NEVER)
    value[0, 0] = 0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for (i, j), own in zip(spans.tolist(), s):
        way = value[i][:, None] + follow
        before = way.argmax(0)
        new = way[before, np.arange(len(KINDS))] + own
        for k in np.flatnonzero(new > value[j]).tolist():
            value[j, k] = new[k]
            back[j, k] = (i, int(before[k]))
    out, j, k = [], n, int(value[n].argmax())
    while j > 0:
        i, before = back[j, k]
        if k:
            out.append((i, j, k))
        j, k = i, before
    return out[::-1]


def examples(n: int) -> list[tuple[str, str, list[tuple[int, int, int]]]]:
    """Seeded (text of an island, context, character spans and kinds); a third have nothing private."""
    rng = np.random.default_rng(20)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda a, b: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(a, b)))
    hexed = lambda k: "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, k))
    octet = lambda: str(rng.integers(0, 256))
    upper = lambda s: s.upper() if rng.random() < 0.2 else s
    email = lambda: upper(letters(2, 9) + pick(["", "." + letters(2, 9), "." + digits(2), digits(2), "_" + letters(2, 5), "-" + letters(2, 5), "+" + letters(2, 5)]) + "@" + letters(3, 9) + pick(["", digits(1), digits(2)]) + pick([".", ".example.", "." + letters(3, 8) + ".", "-" + letters(2, 5) + "."]) + pick(["com", "org", "net", "de", "co", "es", "info"]))
    phone = lambda: pick([f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.integers(1, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(11)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}"])
    card = lambda: pick([digits(16), digits(16), digits(15), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4))])
    address = lambda: ".".join(octet() for _ in range(4))
    secret = lambda: upper(pick([hexed(40), hexed(32), hexed(64), "".join(pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(36)) + "7a"]))
    other = lambda: pick([f"{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", str(rng.integers(0, 100)), str(rng.integers(1500, 2100)), f"{rng.integers(1, 99)}%", f"${digits(3)}.{digits(2)}", f"{rng.integers(1, 13)}:{digits(2)}", f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1900, 2100)}", digits(6), digits(8), f"{digits(1)},{digits(3)},{digits(3)}", letters(1, 3) + digits(2), letters(4, 9) + digits(1), f"[{digits(1)}]", f"@{letters(3, 9)}", f"{rng.integers(256, 999)}.{rng.integers(256, 999)}.{rng.integers(256, 999)}.{rng.integers(256, 999)}", f"{digits(1)}x{digits(2)}", f"({rng.integers(1900, 2100)})", f"v{digits(1)}.{digits(1)}.{digits(1)}", "#" + digits(4), f"{digits(2)}-{digits(2)}"])
    makers = (None, email, phone, card, address, secret)
    out = []
    for _ in range(n):
        text, spans, context = "", [], pick(["", "", "", "secret"])
        for _ in range(int(rng.integers(1, 4))):
            kind = int(rng.integers(1, 6)) if rng.random() < 0.6 else 0
            text += " " if text else ""
            open_, close = pick([("", ""), ("", ""), ("", "."), ("", ","), ("", "!!"), ("", "%%%"), ("", "***"), ("", "###"), ("", "&&&"), ("", "$$$"), ("(", ")"), ('"', '"'), ("<", ">"), ('"', '"!!'), ("", ";"), ("'", "'")])
            text += open_
            made = makers[kind]() if kind else other()
            if kind:
                spans.append((len(text), len(text) + len(made), kind))
            text += made + close
        out.append((text, context, spans))
    return out


@functools.cache
def train() -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature and kind, weights by kind and the kind before it): full-batch Adagrad on the log-likelihood."""
    data, all_features, all_allowed = [], [], []
    for text, context, spans in examples(TRAIN_ISLANDS):
        island = Island(text, context)
        at, to = {a: k for k, (a, _) in enumerate(island.tokens)}, {b: k + 1 for k, (_, b) in enumerate(island.tokens)}
        spans_, features, allowed = island.segments()
        data.append((island.n, spans_, truth(spans_, {(at[a], to[b]): kind for a, b, kind in spans})))
        all_features.append(features)
        all_allowed.append(allowed)
    features, allowed = np.concatenate(all_features), np.concatenate(all_allowed)
    cut = np.append(0, np.cumsum([len(x) for x in all_features]))
    flat, wide = features.ravel(), features.shape[1]
    model = (np.zeros((BUCKETS, len(KINDS))), np.zeros((len(KINDS), len(KINDS))))
    square = [np.full(x.shape, 1e-6) for x in model]
    for _ in range(ROUNDS):
        s, by_span, by_follow = scores(model, features, allowed), np.zeros((len(features), len(KINDS))), -L2 * len(data) * model[1]
        for k, (n, spans, right) in enumerate(data):
            own = slice(cut[k], cut[k + 1])
            _, by_span[own], more = gradient(n, spans, s[own], model[1], right)
            by_follow += more
        by_span[~allowed] = 0
        by_weight = np.stack([np.bincount(flat, np.repeat(by_span[:, k], wide), BUCKETS) for k in range(len(KINDS))], axis=1) - L2 * len(data) * model[0]
        for x, q, g in zip(model, square, (by_weight, by_follow)):
            q += g * g
            x += RATE * g / np.sqrt(q)
    return model


class Finder:
    """Finds private spans in slices of text; remembers up to REMEMBER shapes of islands."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.model, self.known = model, {}

    def island(self, text: str, context: str = "") -> list[tuple[int, int, int]]:
        """(first character, one past the last, kind) of the private spans."""
        x = Island(text, context)
        found = self.known.get(x.key)
        if found is None:
            found = best(self.model, x.n, *x.segments()) if x.n else []
            if len(self.known) >= REMEMBER:
                self.known.clear()
            if x.n <= 64:
                self.known[x.key] = found
        return [(x.tokens[i][0], x.tokens[j - 1][1], kind) for i, j, kind in found]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By row, (first byte, one past the last, kind) in the slice."""
        starts, ends, first = T.words(data, offsets)
        hot = np.unique(np.searchsorted(starts, np.flatnonzero(TRIGGER[data]), side="right") - 1)
        row = np.searchsorted(first, hot, side="right") - 1
        new = np.ones(len(hot), bool)
        new[1:] = (hot[1:] != hot[:-1] + 1) | (row[1:] != row[:-1])
        heads = np.flatnonzero(new)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(hot)).tolist()):
            w, r = hot[a], int(row[a])
            lo, hi = int(starts[w]), int(ends[hot[b - 1]])
            before = data[starts[max(w - 2, first[r])] : starts[w]].tobytes().decode(errors="replace").lower()
            context = "secret" if SECRET_WORDS & set(re.findall(r"\w+", before)) else ""
            text = data[lo:hi].tobytes().decode()
            for x, y, kind in self.island(text, context):
                p = lo + len(text[:x].encode())
                out.setdefault(r, []).append((p, p + len(text[x:y].encode()), kind))
        return out


def _redacted(finder: Finder, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts with the kinds in the place of their spans, numbers of spans, and the spans, counted in characters."""
    out, all_counts, flat = [pa.array([], pa.string())], [np.zeros(0, np.int32)], []
    for lo, hi, data, offsets in T.slices(texts, SLICE):
        column = texts.slice(lo, hi - lo).cast(pa.string())
        take, changed, counts = np.arange(hi - lo), [], np.zeros(hi - lo, np.int32)
        for r, spans in sorted(finder.rows(data, offsets).items()):
            at, parts, chars = int(offsets[r]), [], 0
            for x, y, kind in spans:
                between, own = data[at:x].tobytes().decode(), data[x:y].tobytes().decode()
                chars += len(between)
                flat.append({"first": chars, "last": chars + len(own), "kind": KINDS[kind]})
                chars += len(own)
                parts += [between, f"[{KINDS[kind]}]"]
                at = y
            take[r], counts[r] = hi - lo + len(changed), len(spans)
            changed.append("".join(parts) + data[at : offsets[r + 1]].tobytes().decode())
        out.append(pa.concat_arrays([column, pa.array(changed, pa.string())]).take(pa.array(take)))
        all_counts.append(counts)
    counts = np.concatenate(all_counts)
    kinds = pa.array(flat, pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string())]))
    return pa.concat_arrays(out), pa.array(counts), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), kinds)


def private(documents: DataFrame) -> DataFrame:
    """(doc_id, n_spans, spans, text), one row for every row of documents, whole texts.

    spans are (first, last, kind): the first character, from 0, one past the last, and EMAIL, PHONE, CARD,
    IP or SECRET; text has [EMAIL] and so on in their place. A null text has no spans and stays null, as
    does a null doc_id; repeated rows stay. An entity of over MOST_TOKENS tokens comes out in part or not at all.
    Other columns are neither read nor returned.
    """
    sent = documents.sparkSession.sparkContext.broadcast(train())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            texts, counts, spans = _redacted(finder, batch.column(1))
            yield pa.record_batch({"doc_id": batch.column(0), "n_spans": counts, "spans": spans, "text": texts})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_spans int, spans array<struct<first:int,last:int,kind:string>>, text string")


def redacted(documents: DataFrame) -> DataFrame:
    """All rows of documents (doc_id, text, lang, source, n_chars) with the text of private(), and n_chars its length."""
    sent = documents.sparkSession.sparkContext.broadcast(train())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            yield batch.set_column(1, "text", _redacted(finder, batch.column(1))[0])

    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    return docs.mapInArrow(rows, docs.schema).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
