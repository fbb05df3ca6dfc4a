"""Packing of token sequences into bins by best fit and swap-based local search.

Documents become pieces of at most ``capacity`` tokens on the map side; only longer documents are
cut. Pieces are dealt by a hash of their keys into groups of bounded size, which are packed
independently, so a hot source or a group of copies spreads over all groups and no task ever
sees more than about ``group_pieces`` pieces. Each group starts from best-fit decreasing; then a
local search moves documents, one or two at a time, and exchanges one for one, two for one and one
for two between any two underfull bins whenever that raises the sum of squared fills, so that weak
bins drain until they are empty and disappear. It ends when a group has as few bins as there can
be, or when no such step is left.

Defined results: null text is empty and still gives one piece that holds only the end token; a
null id is packed like any other; repeated rows are packed once each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import bounded_batches, materialize, slices, text_of
from basketry.llm.token_counts import settings_of

_encoders: dict[tuple, _ChunkEncoder] = {}


#: A plain chunk: letters of ASCII and Latin-1, which have no combining forms, then ASCII punctuation but the apostrophe.
_LETTERS = "".join(chr(c) for c in range(0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: The settings of a vocabulary file for which this holds.
CHUNKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


class _ChunkEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, from those of their white-space chunks.

    The vocabulary drops white space before it splits words, so a text's ids are those of its
    chunks in order; equal chunks of a call are looked up once, and texts of ASCII alone are made
    small before they are split. A plain chunk's ids are those of its letters in lower case, which the
    vocabulary takes for one word, and of its tail of punctuation, which it takes for another.
    New words go through the library many at a time, already split; a word's last token, and
    no other, is one with an end mark. Other chunks go to the library one by one, and texts that
    may hold special tokens (in any case, as small letters would make them some) or one of the four separators that split() takes for white
    space and the vocabulary doesn't go there whole. So do all texts where the vocabulary file
    normalises or splits in another way.
    """

    def __init__(self, path: str, cache_entries: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fits = settings_of(path) == CHUNKS
        # these share the model; the byte level writes ASCII letters as themselves, so words of those need no splitter
        self.words_only, self.ascii_only = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(map(re.escape, ["\x1c", "\x1d", "\x1e", "\x1f", *added]))
        self.room, self.words, self.others = cache_entries, {"": b""}, {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each given once."""
        found = list(map(self.words.get, words))
        missing = [word for word, ids in zip(words, found) if ids is None]
        if len(self.words) + len(missing) > self.room:
            self.words = {"": b""}
            missing = [word for word in words if word]
        for library, new in ((self.ascii_only, [word for word in missing if word.isascii()]), (self.words_only, [word for word in missing if not word.isascii()])):
            for at in range(0, len(new), 4000):
                part = new[at : at + 4000]
                (coded,) = library.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)
                ids = np.asarray(coded.ids, dtype="<u4")
                ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
                flat = ids.tobytes()
                self.words.update(zip(part, [flat[i:j] for i, j in zip([0, *ends], ends)], strict=True))
        return list(map(self.words.__getitem__, words)) if missing else found

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of tails, and of chunks that are not plain, each given once."""
        missing = [chunk for chunk in chunks if chunk not in self.others]
        if len(self.others) + len(missing) > self.room:
            self.others = {}
            missing = chunks
        self.others.update((chunk, self._whole(chunk)) for chunk in missing)
        return list(map(self.others.__getitem__, chunks))

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        word, tail = pc.ascii_rtrim(chunks, _TAIL), pc.utf8_ltrim(chunks, _LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(word), pc.binary_length(tail)), pc.binary_length(chunks))
        word = pc.if_else(plain, pc.utf8_lower(word), "").dictionary_encode()
        tail = pc.if_else(plain, tail, chunks).dictionary_encode()
        strings = lambda x: x.dictionary.to_numpy(zero_copy_only=False).tolist()
        told = lambda x, ids: pa.array(ids, pa.large_binary()).take(x.indices)
        return pc.binary_join_element_wise(told(word, self._words(strings(word))), told(tail, self._others(strings(tail))), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        import pyarrow.compute as pc

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = pc.match_substring_regex(column, self.odd, ignore_case=True) if self.fits else pa.array([True] * len(column), pa.bool_())
        # nothing is split of texts that go to the library
        split = pc.if_else(whole, "", column)
        of_ascii = pc.equal(pc.binary_length(split).cast(pa.int64()), pc.utf8_length(split).cast(pa.int64()))
        chunks = pc.utf8_split_whitespace(pc.if_else(of_ascii, pc.ascii_lower(split), split))
        coded = chunks.flatten().dictionary_encode()
        ids = self._chunks(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        at = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))]).astype(np.int64)].tolist()
        flat = memoryview(ids.buffers()[2] or b"")
        return [self._whole(column[k].as_py()) if odd else bytes(flat[i:j]) for k, (odd, i, j) in enumerate(zip(whole.to_pylist(), at, at[1:]))]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, cache_entries: int = 1_500_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut at ``capacity``."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = (path, cache_entries), np.asarray([end_id], dtype="<u4").tobytes()
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = _ChunkEncoder(path, cache_entries)
        encoder = _encoders[key]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encoder.encode(part.column("text"))):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    rows = text_of(docs, id_col, text_col)
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of positions in ``lengths``) by best-fit decreasing."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # free space -> bins that have just that much
    spaces: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(spaces, size)
        if at == len(spaces):
            b, space = len(bins), capacity
            bins.append([])
        else:
            space = spaces[at]
            b = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(at)
        bins[b].append(i)
        if left := space - size:
            if left not in room:
                insort(spaces, left)
                room[left] = []
            room[left].append(b)
    return bins


class _Search:
    """Bins under local search: what each can give, indexed so that a source meets all targets at once.

    A give is what a bin hands back: nothing, one piece or two, known by its length alone, so a bin
    of many small pieces has no more gives than there are lengths up to the capacity. Gives of all
    underfull bins lie in one list that only grows at its end: a bin that changes voids its old gives
    and adds new ones. So a source that found no step has to look at later gives alone.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int) -> None:
        self.capacity = capacity
        self.size = lengths.tolist()
        self.bins = [list(b) for b in bins]
        self.fill = np.asarray([sum(self.size[i] for i in b) for b in bins] + [capacity], dtype=np.int64)  # the last is of void gives
        self.seen = [0] * len(bins)
        self.places: list[tuple[int, int]] = [(0, 0)] * len(bins)
        self.owner, self.back, self.pair = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.end = self.void = 0
        for b in range(len(bins)):
            self._list(b)

    def _sums(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of a bin's pieces, and of all its twos."""
        own, count = np.unique([self.size[i] for i in self.bins[b]], return_counts=True)
        first, second = np.triu_indices(len(own), 1)
        return own, np.unique(np.concatenate([own[first] + own[second], 2 * own[count > 1]]))

    def _list(self, b: int) -> None:
        """Put a bin's gives at the end of the list, in place of those it had."""
        at, until = self.places[b]
        self.owner[at:until] = len(self.bins)
        self.void += until - at
        self.places[b], self.seen[b] = (self.end, self.end), 0
        if not 0 < self.fill[b] < self.capacity:
            return
        one, two = self._sums(b)
        more = 1 + len(one) + len(two)
        if self.end + more > len(self.owner):
            if self.void > self.end // 2:
                self._drop_void()
            if self.end + more > len(self.owner):
                self.owner, self.back, self.pair = (np.concatenate([x, np.zeros(len(x) + more, np.int64)]) for x in (self.owner, self.back, self.pair))
        at, until = self.end, self.end + more
        self.owner[at:until], self.back[at], self.pair[at:until] = b, 0, 0
        self.back[at + 1 : at + 1 + len(one)], self.back[at + 1 + len(one) : until], self.pair[at + 1 + len(one) : until] = one, two, 1
        self.places[b], self.end = (at, until), until

    def _drop_void(self) -> None:
        kept = np.flatnonzero(self.owner[: self.end] < len(self.bins))
        at = lambda x: int(np.searchsorted(kept, x))
        self.seen = [at(x) for x in self.seen]
        self.places = [(at(x), at(y)) for x, y in self.places]
        for rows in (self.owner, self.back, self.pair):
            rows[: len(kept)] = rows[kept]
        self.end, self.void = len(kept), 0

    def improve(self, source: int) -> bool:
        """Apply the source's step that raises the sum of squared fills most; false if no step raises it."""
        since = self.seen[source]
        if since == self.end:
            return False
        one, two = self._sums(source)
        most = np.zeros((2, self.capacity + 1), np.int64)  # the most that goes into so much room: of up to two pieces, of one
        most[:, one] = one
        most[0, two] = two
        np.maximum.accumulate(most, axis=1, out=most)
        owner, back, pair = self.owner[since : self.end], self.back[since : self.end], self.pair[since : self.end]
        fuller = self.fill - self.fill[source]
        fuller[source] = fuller[-1] = -2 * self.capacity
        net = most[pair, (self.capacity - self.fill)[owner] + back] - back
        rise = np.where(net > 0, net * (fuller[owner] + net), 0)
        best = int(rise.argmax())
        if rise[best] <= 0:
            self.seen[source] = self.end
            return False
        target, given, taken = int(owner[best]), int(back[best]), int(back[best] + net[best])
        out = self._pieces(source, taken, 2 - int(pair[best]))
        returned = self._pieces(target, given, 2) if given else []
        self.bins[source] = [x for x in self.bins[source] if x not in out] + returned
        self.bins[target] = [x for x in self.bins[target] if x not in returned] + out
        self.fill[source] -= net[best]
        self.fill[target] += net[best]
        self._list(source)
        self._list(target)
        return True

    def _pieces(self, b: int, length: int, most: int) -> list[int]:
        """One piece of that length in a bin, or else two."""
        at: dict[int, int] = {}
        for i in self.bins[b]:
            if self.size[i] == length:
                return [i]
        for i in self.bins[b]:
            if most == 2 and length - self.size[i] in at:
                return [at[length - self.size[i]], i]
            at.setdefault(self.size[i], i)
        raise AssertionError("a step of pieces that are not there")


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, rounds: int | None = None) -> list[list[int]]:
    """Raise the sum of squared fills by moves, 1-1, 2-1 and 1-2 exchanges until there are as few bins as there can be or no step improves.

    From the emptiest up, each underfull bin is a source whose documents go to any other underfull
    bin: one or two outright where they fit, else in exchange for one or two smaller documents
    that the other gives back. The step that raises the sum most is taken. It rises strictly, so
    the search ends; where it ends above the least number of bins, no such step between any two
    bins is left. ``rounds`` bounds the passes over all bins if it is given.
    """
    least = -(-int(lengths.sum()) // capacity)
    live = sum(1 for b in bins if b)
    if live <= least:
        return [b for b in bins if b]
    search = _Search(lengths, bins, capacity)
    changed = True
    while changed and rounds != 0:
        changed, rounds = False, None if rounds is None else rounds - 1
        for source in np.argsort(search.fill[:-1], kind="stable").tolist():
            while 0 < search.fill[source] < capacity and search.improve(source):
                changed = True
            if not search.fill[source] and bins[source] and not search.bins[source]:
                live = sum(1 for b in search.bins if b)
                if live <= least:
                    return [b for b in search.bins if b]
    return [b for b in search.bins if b]


def pack(parts: DataFrame, capacity: int = 4096, group_pieces: int = 8192) -> DataFrame:
    """``parts`` (as from pieces()) with sequence_id and a gapless offset.

    A sequence id is the group's number times 2^32 plus the bin's number in the group.
    """
    parts = materialize(parts, "pieces")
    groups = max(1, -(-parts.count() // group_pieces))
    schema = parts.schema.simpleString()[7:-1]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition may hold several groups, sorted by group: pack each as soon as it is whole
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column("pack_group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if now is not None and keys[lo] != now:
                    yield solve(held)
                    held = []
                now = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for n, members in enumerate(local_search(lengths, best_fit(lengths, capacity), capacity)):
            at = np.asarray(members)
            sequence[at] = n
            offset[at] = np.concatenate([[0], np.cumsum(lengths[at])[:-1]])
        sequence += rows.column("pack_group").to_numpy() << 32
        rows = rows.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return rows.to_batches()[0]

    dealt = parts.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "piece"), F.lit(groups)))
    dealt = dealt.repartition(min(groups, 4096), "pack_group").sortWithinPartitions("pack_group")
    return dealt.mapInArrow(fit, f"{schema}, sequence_id long, offset long")


def packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, group_pieces: int = 8192, cache_entries: int = 1_500_000) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    ``cache_entries`` bounds what a worker remembers, at about 200 bytes an entry; it changes speed alone.
    """
    return pack(pieces(docs, path, id_col, text_col, capacity, end_id, cache_entries), capacity, group_pieces)
