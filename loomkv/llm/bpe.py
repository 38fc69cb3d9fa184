"""op6: byte-level BPE encoding and decoding, by recursive DuckDB queries in each partition.

A text is split into words by the vocabulary's pattern. Rows of (word, position, token), bytes at first,
join the table of merges; in every round each word's leftmost pair of the lowest rank is contracted,
until no pair is left. In words of over LONG bytes a round contracts all places of that pair, leftmost
first where they overlap, which ends in the same tokens, as a pair made by a merge always has a higher
rank than the merge. Decoding joins tokens to their bytes and aggregates them in order of position.

A slice's distinct words (by 64-bit hash) are encoded once, and a worker remembers up to REMEMBER of
them, which changes nothing but time: a text whose tokens do not decode to its own bytes, as two words of
one hash would have it, is encoded again by itself and without hashes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm import text as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_TOKENS = 1 << 20
REMEMBER = 1_500_000
WORDS = 40_000
LONG = 128
SLICE = 1 << 22
DECODE = 1 << 20

WORD_SQL = """
WITH RECURSIVE t(i, w, toks) AS (
  SELECT 0, w, list(tok ORDER BY p) FROM start GROUP BY w
  UNION ALL
  SELECT i + 1, t.w, list_concat(list_append(toks[:(best & 1048575) - 1], CAST(best >> 20 AS INTEGER)), toks[(best & 1048575) + 2:])
  FROM t JOIN (
    SELECT w, min((m.made::BIGINT << 20) | p) AS best
    FROM (SELECT w, generate_subscripts(toks, 1) AS p, (unnest(toks)::BIGINT << 20) | unnest(toks[2:]) AS pair FROM t) u
    JOIN merges m ON m.pair = u.pair GROUP BY w) c ON c.w = t.w
)
SELECT w, arg_max(toks, i) AS toks FROM t GROUP BY w ORDER BY w"""
LONG_SQL = """
WITH RECURSIVE t(i, w, p, tok) AS (
  SELECT 0, w, p, tok FROM start
  UNION ALL
  SELECT i + 1, w, p, CASE WHEN hit THEN best ELSE tok END
  FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone
    FROM (SELECT *, here AND (NOT twin OR (n - coalesce(max(CASE WHEN NOT here THEN n END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1) AS hit
      FROM (SELECT *, coalesce(made = best, false) AS here
        FROM (SELECT u.*, m.made, u.tok = u.nx AS twin, min(m.made) OVER (PARTITION BY u.w) AS best
          FROM (SELECT i, w, p, tok, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nx, row_number() OVER (PARTITION BY w ORDER BY p) AS n FROM t) u
          LEFT JOIN merges m ON m.pair = (u.tok::BIGINT << 20) | u.nx)
        WHERE best IS NOT NULL)))
  WHERE NOT gone
)
SELECT w, list(tok ORDER BY p) AS toks FROM (SELECT *, max(i) OVER (PARTITION BY w) AS last FROM t) WHERE i = last GROUP BY w ORDER BY w"""
DECODE_SQL = "SELECT place >> 40 AS row, string_agg(s, '') AS s FROM (SELECT s.place, v.s FROM s JOIN vocabulary v ON v.tok = s.tok ORDER BY s.place) GROUP BY row ORDER BY row"


def _classes() -> np.ndarray:
    """By code point: 0 the space, 1 other white space, 2 letters, 3 numbers, 4 all else, as the pattern's module has them."""
    out = np.full(0x110000, 4, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for k, kind in ((1, r"\s+"), (2, r"\p{L}+"), (3, r"\p{N}+")):
        for m in regex.finditer(kind, every):
            out[m.start() : m.end()] = k
    out[32] = 0
    return out


_CLASSES: list[np.ndarray] = []
CONTINUES = np.zeros(256, bool)
CONTINUES[128:192] = True


def segment(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's words over all rows (each ends where the next starts), and the number of each row's."""
    size = len(data)
    if not _CLASSES:
        _CLASSES.append(_classes())
    table = _CLASSES[0]
    kind = table[:256][data]
    lead = ~CONTINUES[data]
    d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    for low, high, n, mask in ((0xC0, 0xE0, 1, 31), (0xE0, 0xF0, 2, 15), (0xF0, 0xF8, 3, 7)):
        at = np.flatnonzero((data >= low) & (data < high))
        code = d[at] & mask
        for k in range(1, n + 1):
            code = (code << 6) | (d[at + k] & 63)
        for k in range(n + 1):
            kind[at + k] = table[code]
    group = np.maximum(kind, 1)
    start = np.zeros(size + 1, bool)
    start[1:-1] = group[1:] != group[:-1]
    start[offsets] = True
    run = np.flatnonzero(start)
    run = run[run < size]
    end = np.append(run[1:], size)
    final = np.zeros(size + 1, bool)
    final[offsets] = True
    inner = (group[run] == 1) & ~final[end]
    after, last = end[inner], end[inner] - 1
    while True:
        inside = ~lead[last]
        if not inside.any():
            break
        last = last - inside
    start[last] = True
    start[after[kind[last] == 0]] = False
    quote = run[(end - run == 1) & (data[run] == 39) & start[run] & ~final[end]]
    one, two = d[quote + 1], d[np.minimum(quote + 2, size)]
    near = np.isin(one, np.frombuffer(b"sdmt", np.uint8))
    far = ~near & ~final[np.minimum(quote + 2, size)] & (((one == 108) & (two == 108)) | (((one == 118) | (one == 114)) & (two == 101)))
    start[quote[near | far] + 1] = False
    start[quote[near] + 2] = True
    start[quote[far] + 3] = True
    starts = np.flatnonzero(start[:-1])
    return starts, np.diff(np.searchsorted(starts, offsets))


@functools.cache
def vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each token, and the merges (left, right, made): the two tokens that the lower ranks leave of each longer one."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"{len(ranks)} tokens: over the {MOST_TOKENS} that may be sent to each worker")
    pieces = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    merges, of = [], {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [ranks[bytes([b])] for b in token]
        while len(parts) > 2:
            best = min((of.get((a, b), rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                raise ValueError(f"token {rank} is not the merge of two others")
            parts[best[1] : best[1] + 2] = [best[0]]
        if len(parts) == 2:
            of[parts[0], parts[1]] = rank
            merges.append((parts[0], parts[1], rank))
    return pieces, np.array(merges, np.int32).reshape(-1, 3)


def connection(pieces: list[bytes], merges: np.ndarray) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    con.register("m", pa.table({"pair": (merges[:, 0].astype(np.int64) << 20) | merges[:, 1], "made": merges[:, 2]}))
    con.register("v", pa.table({"tok": np.arange(len(pieces), dtype=np.int32), "s": [x.decode("latin-1").replace("\0", "\u0100") for x in pieces]}))
    con.execute("CREATE TABLE merges AS FROM m")
    con.execute("CREATE TABLE vocabulary AS FROM v")
    return con


def encode_words(con: duckdb.DuckDBPyConnection, byte_ids: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words on end, and how many each has; the words are data cut into sizes."""
    counts, runs = np.zeros(len(sizes), np.int64), []
    starts = np.cumsum(sizes) - sizes
    for sql, some, most in ((WORD_SQL, np.flatnonzero(sizes <= LONG), WORDS), (LONG_SQL, np.flatnonzero(sizes > LONG), 256)):
        for k in range(0, len(some), most):
            part = some[k : k + most]
            n = sizes[part]
            w = np.repeat(np.arange(len(part), dtype=np.int32), n)
            con.register("start", pa.table({"w": w, "p": T.ragged(np.zeros(len(part), np.int64), n), "tok": byte_ids[data[T.ragged(starts[part], n)]]}))
            found = con.sql(sql).to_arrow_table()["toks"].combine_chunks()
            con.unregister("start")
            counts[part] = np.diff(found.offsets.to_numpy())
            runs.append((part, found.flatten().to_numpy()))
    ends = np.cumsum(counts)
    tokens = np.zeros(ends[-1] if len(ends) else 0, np.int32)
    for part, found in runs:
        tokens[T.ragged(ends[part] - counts[part], counts[part])] = found
    return tokens, counts


class Encoder:
    """Encodes and decodes; one for each partition. memory outlives it."""

    def __init__(self, pieces: list[bytes], merges: np.ndarray, memory: dict | None = None) -> None:
        self.con = connection(pieces, merges)
        self.byte_ids = np.zeros(256, np.int32)
        for k, x in enumerate(pieces):
            if len(x) == 1:
                self.byte_ids[x[0]] = k
        self.memory = {} if memory is None else memory

    def _known(self) -> tuple[np.ndarray, ...]:
        """Sorted hashes, for each the start and number of its tokens, and all tokens."""
        return self.memory.setdefault("known", (np.zeros(0, T.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows on end, and how many each has."""
        starts, words = segment(data, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        distinct, first, at = np.unique(T.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        hashes, begin, count, tokens = self._known()
        if len(hashes) + len(distinct) > REMEMBER:
            self.memory.clear()
            hashes, begin, count, tokens = self._known()
        slot = np.searchsorted(hashes, distinct)
        new = np.ones(len(distinct), bool)
        new[slot < len(hashes)] = hashes[slot[slot < len(hashes)]] != distinct[slot < len(hashes)]
        if new.any():
            some = first[new]
            sizes = ends[some] - starts[some]
            more, n = encode_words(self.con, self.byte_ids, data[T.ragged(starts[some], sizes)], sizes)
            where = slot[new]
            hashes = np.insert(hashes, where, distinct[new])
            begin, count = np.insert(begin, where, len(tokens) + np.cumsum(n) - n), np.insert(count, where, n)
            tokens = np.concatenate([tokens, more])
            self.memory["known"] = (hashes, begin, count, tokens)
            slot = np.searchsorted(hashes, distinct)
        begin, count = begin[slot][at], count[slot][at]
        total = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(words))]
        return tokens[T.ragged(begin, count)], np.diff(total)

    def encode_alone(self, data: np.ndarray) -> np.ndarray:
        starts, _ = segment(data, np.array([0, len(data)]))
        return encode_words(self.con, self.byte_ids, data, np.diff(np.append(starts, len(data))))[0]

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of counts[k] tokens."""
        at = (np.repeat(np.arange(len(counts)), counts) << 40) | T.ragged(np.zeros(len(counts), np.int64), counts)
        parts: list[list[bytes]] = [[] for _ in counts]
        for k in range(0, len(tokens), DECODE):
            self.con.register("s", pa.table({"place": at[k : k + DECODE], "tok": tokens[k : k + DECODE]}))
            found = self.con.sql(DECODE_SQL).to_arrow_table()
            self.con.unregister("s")
            for row, s in zip(found["row"].to_pylist(), found["s"].to_pylist()):
                parts[row].append(s.replace("\u0100", "\0").encode("latin-1"))
        return [b"".join(x) for x in parts]


_MEMORY: dict = {}


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, same), one row for every row of documents, whole texts.

    same is 1 if decoding the tokens gives the text's bytes again. An empty text has no tokens; a null one
    has null tokens and same, and n_tokens 0. Text that spells a special token is ordinary text. Other
    columns are neither read nor returned.
    """
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, merges = sent.value
        encoder = Encoder(pieces, merges, _MEMORY.setdefault(path, {}))
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1), SLICE):
                texts, ids = batch.column(1).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo)
                tokens, counts = encoder.encode(data, offsets)
                same = np.ones(hi - lo, np.int32)
                for k, back in enumerate(encoder.decode(tokens, counts)):
                    if back != (own := data[offsets[k] : offsets[k + 1]]).tobytes():
                        cut = np.cumsum(counts)
                        alone = encoder.encode_alone(own)
                        tokens, counts[k] = np.concatenate([tokens[: cut[k] - counts[k]], alone, tokens[cut[k] :]]), len(alone)
                        same[k] = encoder.decode(alone, np.array([len(alone)]))[0] == own.tobytes()
                gone = pc.is_null(texts).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(tokens.astype(np.int32)), mask=pa.array(gone))
                yield pa.record_batch({"doc_id": ids, "n_tokens": pa.array(counts), "tokens": lists, "same": pa.array(same, pa.int32(), mask=gone)})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_tokens long, tokens array<int>, same int")


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens); null tokens give a null text, bytes that are not UTF-8 U+FFFD. Tokens outside the vocabulary raise."""
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, merges = sent.value
        encoder = Encoder(pieces, merges)
        for batch in batches:
            column = batch.column(1)
            gone = pc.is_null(column).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(pieces) or not all(pieces[k] for k in np.unique(flat))):
                raise ValueError("a token is outside the vocabulary")
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [x.decode(errors="replace") for x in encoder.decode(flat, counts)]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string(), mask=gone)})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(rows, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
