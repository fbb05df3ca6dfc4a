"""Byte-level BPE by recursive queries in an in-process DuckDB, one per worker.

Every distinct pre-token that a worker has not met becomes token-position rows (word, position,
token), at first one row a byte. A recursive query joins neighbouring rows with the merge table,
finds each word's leftmost pair of least rank, contracts it, and goes on with the words that
changed, until none has a pair left. The recursion is keyed by word and position, so that it holds
one state and not those of all steps. Decoding joins ids with the vocabulary and concatenates the
bytes by ordered aggregation.

A word of more than ``SEGMENT`` bytes is cut into segments, each contracted as a word of its own. A
cut stands if the tokens beside it, taken alone as one text, contract to themselves; else its two
segments are joined and contracted again. This is exact, whatever the ranks: take the first step of
the whole word that would contract a pair across a boundary of the result. Until then nothing
crossed any boundary, so between the two neighbours the same steps were taken, in the same order,
as for these two alone, and these would be contracted across the boundary too, which they are not.

Nothing is shuffled; the state of a worker is a bounded cache, rebuilt from the rank file when an
executor is lost.

Defined results: null text is empty (no tokens; digests of nothing); a null id stays null;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import bounded_batches, slices, text_of
from basketry.llm.token_counts import PRE_TOKENS

SEGMENT = 48
_BYTES_A_QUERY = 600_000
_TOKENS_A_QUERY = 500_000

#: One pair a step: the leftmost of least rank. Rows keep their first byte's position; -1 marks those contracted into the one before.
_CONTRACT = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
    SELECT word, pos, token FROM letters
  UNION ALL (
    WITH pairs AS MATERIALIZED (
        SELECT *, lead(token) OVER w AS following, lag(pos) OVER w AS before
        FROM state WHERE token >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)),
    least AS (
        SELECT word, min((rank::BIGINT << 32) | pos) AS best
        FROM pairs JOIN merges ON pair = (token::BIGINT << 20) | following GROUP BY word)
    SELECT word, pos, CASE WHEN pos = (best & 4294967295) THEN (best >> 32)::INT WHEN before = (best & 4294967295) THEN -1 ELSE token END
    FROM pairs JOIN least USING (word)))
SELECT word, token FROM state WHERE token >= 0 ORDER BY word, pos
"""

#: Bytes stand for the characters U+0000 to U+00FF while they are strings in DuckDB.
_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY n) AS text FROM ids JOIN vocabulary USING (token) GROUP BY doc"

_codecs: dict[tuple, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, cache_entries: int = 1_400_000, memory_mb: int = 256) -> None:
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.find, self.room = regex.compile(PRE_TOKENS).findall, cache_entries
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": f"{memory_mb}MB", "preserve_insertion_order": "false", "temp_directory": ""})
        self.byte = np.asarray([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    merged.append(rank)
        self._table("merges", pair=pa.array(pairs, pa.int64()), rank=pa.array(merged, pa.int32()))
        self._table("vocabulary", token=pa.array(list(ranks.values()), pa.int32()), piece=pa.array([t.decode("latin-1") for t in ranks]))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = [str(n) for n in range(max(ranks.values()) + 1)]
        self.ids: dict[str, bytes] = {}

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, by the recursive query, some hundred thousand bytes at a time."""
        out: list[bytes] = []
        sizes = np.asarray([len(w) for w in words], dtype=np.int64)
        part = np.cumsum(sizes) // _BYTES_A_QUERY
        for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side=s).tolist() for s in ("left", "right"))):
            size = sizes[lo:hi]
            raw = np.frombuffer(b"".join(words[lo:hi]), dtype=np.uint8)
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
            rows = pa.table({"word": pa.array(np.repeat(np.arange(hi - lo, dtype=np.int32), size)), "pos": pa.array(pos.astype(np.int32)), "token": pa.array(self.byte[raw])})
            self.db.register("letters", rows)
            found = self.db.sql(_CONTRACT).to_arrow_table()
            self.db.unregister("letters")
            cuts = (4 * np.searchsorted(found.column("word").to_numpy(), np.arange(hi - lo + 1))).tolist()
            flat = found.column("token").to_numpy().astype("<u4").tobytes()
            out += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        """The same for words of any length, in segments whose cuts are proved."""
        parts = [[w[at : at + SEGMENT] for at in range(0, len(w), SEGMENT)] for w in words]
        known: dict[bytes, bytes] = {}
        stands: dict[tuple[bytes, bytes], bool] = {}
        open_ = list(range(len(words)))
        while open_:
            new = list({p for k in open_ for p in parts[k]}.difference(known))
            known.update(zip(new, self._contract(new)))
            sides = {k: [(known[a][-4:], known[b][:4]) for a, b in zip(parts[k], parts[k][1:])] for k in open_}
            pairs = list({x for own in sides.values() for x in own}.difference(stands))
            texts = [self.bytes_of[int.from_bytes(a, "little")] + self.bytes_of[int.from_bytes(b, "little")] for a, b in pairs]
            stands.update((x, found == x[0] + x[1]) for x, found in zip(pairs, self._contract(texts)))
            still = []
            for k in open_:
                joined, at = [], 0
                while at < len(parts[k]):
                    # of three that hang together two are joined now: a run of one letter then grows by doubling
                    two = at < len(sides[k]) and not stands[sides[k][at]]
                    joined.append(parts[k][at] + parts[k][at + 1] if two else parts[k][at])
                    at += 2 if two else 1
                if len(joined) < len(parts[k]):
                    still.append(k)
                parts[k] = joined
            open_ = still
        return [b"".join(known[p] for p in own) for own in parts]

    def learn(self, words: set[str]) -> None:
        missing = list(words.difference(self.ids))
        if len(self.ids) + len(missing) > self.room:
            self.ids = {}
            missing = list(words)
        coded = [w.encode() for w in missing]
        for some, contract in (([k for k, w in enumerate(coded) if len(w) <= SEGMENT], self._contract), ([k for k, w in enumerate(coded) if len(w) > SEGMENT], self._contract_long)):
            self.ids.update(zip([missing[k] for k in some], contract([coded[k] for k in some])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian 32-bit bytes."""
        words = [self.find(t) for t in texts]
        self.learn(set().union(*words))
        ids = self.ids.__getitem__
        return [b"".join(map(ids, w)) for w in words]

    def decimals(self, coded: bytes) -> str:
        """Ids in decimal, with single spaces between them."""
        return " ".join(map(self.decimal.__getitem__, np.frombuffer(coded, dtype="<u4").tolist()))

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        # long ones in stretches, and some stretches a query, so that a query's memory is bounded
        stretches = [(k, c[at : at + 4 * _TOKENS_A_QUERY]) for k, c in enumerate(coded) for at in range(0, len(c), 4 * _TOKENS_A_QUERY)]
        sizes = np.asarray([len(c) // 4 for _, c in stretches], dtype=np.int64)
        part = np.cumsum(sizes) // _TOKENS_A_QUERY
        out: list[list[bytes]] = [[] for _ in coded]
        for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side=s).tolist() for s in ("left", "right"))):
            token = np.frombuffer(b"".join(c for _, c in stretches[lo:hi]), dtype="<u4").astype(np.int32)
            rows = pa.table({"doc": pa.array(np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])), "n": pa.array(np.arange(len(token), dtype=np.int32)), "token": pa.array(token)})
            self.db.register("ids", rows)
            found = dict(self.db.sql(_DECODE).fetchall())
            self.db.unregister("ids")
            for k in range(lo, hi):
                out[stretches[k][0]].append(found[k - lo].encode("latin-1"))
        return [b"".join(own) for own in out]


def codec(path: str, cache_entries: int = 1_400_000) -> Codec:
    """This worker's codec for a rank file."""
    key = (path, cache_entries)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, cache_entries)
    return _codecs[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 1_400_000) -> DataFrame:
    """doc_id, ids (array of ints): the tokens of every row's text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                coded = codec(path, cache_entries).encode(part.column("text").to_pylist())
                flat = pa.array(np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32))
                cuts = pa.array(np.cumsum([0, *(len(c) // 4 for c in coded)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(cuts, flat)], ["doc_id", "ids"])

    rows = text_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", cache_entries: int = 1_400_000) -> DataFrame:
    """doc_id, data (binary): the bytes of every row's ids; null ids stand for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [np.asarray(x or [], dtype="<u4").tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec(path, cache_entries).decode(coded), pa.binary())], ["doc_id", "data"])

    from pyspark.sql import functions as F

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 1_400_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode every text, decode the ids, digest both, in one pass."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = codec(path, cache_entries)
                coded = own.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(own.decimals(c).encode()).hexdigest() for c in coded]), pa.array([hashlib.sha256(d).hexdigest() for d in own.decode(coded)])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = text_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
