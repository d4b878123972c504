"""SentencePiece encoding and decoding with a relational lattice (operator 9).

Texts are cut where no piece can reach across (before a space, and between two characters that are neighbours in no
piece), and the segments are encoded apart, which is exact. For each distinct segment all substrings up to the longest
piece are exploded and equi-joined to the piece table; the matching edges are grouped by segment and folded with a
higher-order aggregate. For piece tables with log probabilities (unigram models) the fold is Viterbi. For merge tables
(BPE models, whose scores are ranks) the best sum of ranks isn't what such a model encodes, so the fold applies, until
none is left, the edge of the lowest rank that spans two pieces of that moment. One pass in order of rank does this if,
for each edge, the piece alone is in two parts when its turn comes: between two cuts a word is folded as if it were
alone, so an edge that isn't applied at its turn never will be. Words with one of the few other pieces (`late`: runs of
spaces) are folded by steps that each look at all edges. Characters without a piece become byte pieces.

So that texts needn't be exploded, a dictionary of frequent segments, from a bounded sample of texts (about `sample_docs`
of them, `dictionary_size` segments; only speed depends on it), is encoded by the lattice first and broadcast. Each text
is cut once: what is exchanged, by chunks of about CHUNK_BYTES of text, is the numbers of its segments and the names of
those that the dictionary lacks. The lacking segments of each chunk are exchanged by name, encoded by the lattice once
each, and sent back to the chunk, where the ids of whole texts are put together. Both readers of either exchange stand in
one plan, so that it is made once.

Defined results: a null or empty text has no pieces, and decodes as empty. Segments of any length are encoded; those over
LONG characters, which exploded rows would carry along whole, are folded where their text is put together, on edges
looked up in the same table. Repeated rows are encoded each; other columns pass through,
whatever their names, but piece_ids is replaced. Empty tables give empty results. The sign for a space, U+2581, in a text
is a space. U+0000 is a character as any other.
"""

from __future__ import annotations

import ctypes
import gc
import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.scratch import materialize

SPACE = "▁"
LONG = 60
CHUNK_BYTES = 4_000_000
KEPT_WORDS = 150_000
#: Characters that texts rarely have; one that a text lacks marks where its words end.
MARKS = "\x01\x02\x03\x04\x05\x06\x07\x0e\x0f\uffff"


@dataclass(frozen=True)
class PieceTable:
    """Pieces with ids and scores; `bytes` are the 256 ids of byte pieces; `merges` if scores are ranks of merges."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes: tuple[int, ...]
    merges: bool

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def single(self) -> float:
        """What a character alone costs in the Viterbi fold."""
        return max((-x for p, _, x in self.pieces if len(p) == 1), default=0.0)

    def neighbours(self) -> frozenset[str]:
        """Pairs of characters that stand side by side in a piece."""
        return frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))

    def late(self) -> frozenset[str]:
        """Pieces that the edges of lower ranks inside them, applied in order, don't leave in two parts."""
        neg = {p: -x for p, _, x in self.pieces if len(p) > 1}

        def waits(p: str) -> bool:
            n, cuts = len(p), (1 << len(p) + 1) - 1
            inner = ((p[s : s + k], s, s + k) for s in range(n) for k in range(2, min(n, n - s + 1)))
            for _, s, e in sorted((neg[x], s, e) for x, s, e in inner if neg.get(x, math.inf) < neg[p]):
                inside = cuts & ((1 << e) - (1 << s + 1))
                if cuts >> s & 1 and cuts >> e & 1 and inside.bit_count() == 1:
                    cuts ^= inside
            return cuts.bit_count() != 3

        return frozenset(filter(waits, neg))

    def ids(self) -> dict[str, int]:
        return {p: i for p, i, _ in self.pieces}

    def texts(self) -> pa.Array:
        """The bytes of each id, with a plain space for its sign; the last is empty."""
        found = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        return pa.array([*(found.get(i, b"") for i in range(max(found) + 1)), b""], pa.large_binary())


def load_table(model: str) -> PieceTable:
    """From a SentencePiece model file that the driver can read; it is sent on as data."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(m.get_piece_size())
    plain = tuple((m.id_to_piece(i), i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    byte = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
    fallback = tuple(byte.get(f"<0x{b:02X}>", m.unk_id()) for b in range(256))
    return PieceTable(plain, fallback, all(float(s).is_integer() for _, _, s in plain))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def edges_of(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, edges, late): of distinct words, the substrings of two characters or more that are pieces, in order
    of cost, and whether one of them is late in a table of merges.

    An edge is a struct of the negated score and, for merges, bits: its `ends` and what is `inside`; else the positions
    s and e, from 0, of begin and end. Words without any such substring are left out. `words` should be partitioned by
    word; then nothing is exchanged, as the piece table has a fixed size and is broadcast. The join is on the
    hashes of the strings, as numbers are looked up faster; the strings are compared in a way that isn't taken for a key.
    """
    late = table.late() if table.merges else frozenset()
    pieces = words.sparkSession.createDataFrame([(p, -x, p in late) for p, _, x in table.pieces if len(p) > 1], "piece string, neg double, late boolean")
    n, s, e = F.length("word"), F.col("s"), F.col("s") + F.col("l")
    starts = words.select("word", F.explode(F.when(n >= 2, F.sequence(F.lit(0), n - 2))).alias("s"))
    lengths = F.sequence(F.lit(2), F.least(F.lit(table.longest), n - s))
    parts = starts.select("word", "s", F.explode(lengths).alias("l")).select("word", "s", e.alias("e"), F.substr("word", s + 1, F.col("l")).alias("part"))
    found = parts.withColumn("h", F.xxhash64("part")).join(F.broadcast(pieces.withColumn("h", F.xxhash64("piece"))), "h").filter("part >= piece and part <= piece")
    begin, end = _bit(F.col("s")), _bit(F.col("e"))
    edge = F.struct(F.col("neg").cast("int").alias("neg"), begin.bitwiseOR(end).alias("ends"), (end - F.lit(2) * begin).alias("inside")) if table.merges else F.struct("neg", "s", "e")
    first = F.xxhash64("word").alias("h")  # numbers sort faster than words
    return found.groupBy(first, "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.max("late").alias("late")).drop("h")


def _meets(cuts: Column, x: Column) -> Column:
    """Whether an edge spans two pieces: both ends are cuts, and one is between them."""
    return (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inside"])) == 1)


def _merge_fold(word: Column, edges: Column, late: Column) -> Column:
    """Cuts as bits of a long. Each merge takes the edge of the lowest rank that spans two pieces then."""
    start = _bit(F.length(word) + 1) - 1

    def once(cuts: Column, x: Column) -> Column:
        return F.when(_meets(cuts, x), cuts.bitwiseAND(F.bitwise_not(x["inside"]))).otherwise(cuts)

    def lowest(cuts: Column, _: Column) -> Column:
        x = F.get(F.filter(edges, lambda x: _meets(cuts, x)), F.lit(0))
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(x["inside"])), cuts)

    return F.when(late, F.aggregate(F.sequence(F.lit(2), F.length(word)), start, lowest)).otherwise(F.aggregate(edges, start, once))


def _viterbi_fold(word: Column, edges: Column, single: float) -> Column:
    """Cuts, as bits of a long, of the best sum of scores; any character alone is an edge of the cost `single`. Of equal
    sums the piece that begins first wins."""
    state = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("cuts")))

    def step(best: Column, e: Column) -> Column:
        own = F.struct(F.lit(single).alias("neg"), (e - 1).cast("int").alias("s"), e.cast("int").alias("e"))
        steps = F.transform(F.concat(F.filter(edges, lambda x: x["e"] == e), F.array(own)), lambda x: F.struct((F.element_at(best, x["s"] + 1)["cost"] + x["neg"]).alias("cost"), x["s"].alias("s")))
        least = F.array_min(steps)
        return F.concat(best, F.array(F.struct(least["cost"].alias("cost"), F.element_at(best, least["s"] + 1)["cuts"].bitwiseOR(_bit(e)).alias("cuts"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), state, step), -1)["cuts"]


def fold_in_python(n: int, edges: list[tuple[float, int, int]], merges: bool, single: float) -> list[int]:
    """The cuts of a long word of n characters from its edges, by the same rules."""
    if merges:
        after, before = {s: s + 1 for s in range(n)}, {s + 1: s for s in range(n)}
        ranks = {(s, e): neg for neg, s, e in edges}
        open_edges = [(neg, s, e) for neg, s, e in edges if e - s == 2]
        heapq.heapify(open_edges)
        while open_edges:
            _, s, e = heapq.heappop(open_edges)
            middle = after.get(s)
            if middle is not None and after.get(middle) == e:
                after[s], before[e] = e, s
                del after[middle], before[middle]
                for x, y in ((before.get(s), e), (s, after.get(e))):
                    if (x, y) in ranks:
                        heapq.heappush(open_edges, (ranks[x, y], x, y))
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        return cuts
    ending: dict[int, list] = {}
    for neg, s, e in edges:
        ending.setdefault(e, []).append((neg, s))
    best = [(0.0, 0)]
    for e in range(1, n + 1):
        best.append(min((best[s][0] + neg, s) for neg, s in [*ending.get(e, []), (single, e - 1)]))
    cuts = [n]
    while cuts[-1] > 0:
        cuts.append(best[cuts[-1]][1])
    return cuts[::-1]


def encode_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, cuts): where distinct words, of LONG characters at most, are cut, as bits of a long.

    Words that aren't in the result are cut between all characters. See edges_of() for the partitioning of `words`.
    """
    edges = edges_of(words, table)
    fold = _merge_fold(F.col("word"), F.col("edges"), F.col("late")) if table.merges else _viterbi_fold(F.col("word"), F.col("edges"), table.single)
    return edges.select("word", fold.alias("cuts"))


class _Ids:
    """Piece ids of words from their cuts; of words over LONG characters from the edges that it looks up itself."""

    def __init__(self, table: PieceTable) -> None:
        self.ids, self.table = table.ids(), table
        self.neg = {p: -x for p, _, x in table.pieces if len(p) > 1}

    def of(self, word: str, cuts: int | None) -> list[int]:
        if len(word) > LONG:
            ends = range(2, self.table.longest + 1)
            edges = [(self.neg[word[s : s + k]], s, s + k) for s in range(len(word)) for k in ends if s + k <= len(word) and word[s : s + k] in self.neg]
            at = fold_in_python(len(word), edges, self.table.merges, self.table.single)
        elif cuts is not None:
            at = [i for i in range(len(word) + 1) if cuts >> i & 1]
        else:
            at = range(len(word) + 1)
        out: list[int] = []
        for s, e in zip(at, at[1:], strict=False):
            piece = self.ids.get(word[s:e])
            out += [piece] if piece is not None else [self.table.bytes[b] for b in word[s:e].encode()]
        return out


def words_of(text: str) -> list[str]:
    """The words of a text: each begins with its spaces, the first one's included; a line break is a word. Empty strings
    among them mean nothing."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    mark = next((m for m in MARKS if m not in text), None)
    if mark is None:
        return re.findall(r" +[^ \n]*|[^ \n]+|\n", " " + text)
    out = (" " + text).replace(" ", mark + " ")
    if "  " in text or text[:1] == " ":
        for _ in range(2):  # the first round leaves pairs
            out = out.replace(f" {mark} ", "  ")
    if "\n" in text:
        out = out.replace("\n", f"{mark}\n{mark}")
    return out.split(mark)


def cut_apart(word: str, neighbours: frozenset[str]) -> list[str]:
    """The segments of a word (with the sign for spaces) that pieces don't reach across."""
    out, begin = [], 0
    for i in range(1, len(word)):
        if word[i - 1 : i + 1] not in neighbours:
            out.append(word[begin:i])
            begin = i
    out.append(word[begin:])
    return out


def segments_of(table: PieceTable):
    """A function from words (with the sign for spaces) to segments that pieces don't reach across.

    Where no piece goes on after a letter with anything else, a pattern cuts there; only segments that are still over LONG
    characters are cut further.
    """
    neighbours = table.neighbours()
    if any(x[1] == SPACE and x[0] != SPACE for x in neighbours):
        raise ValueError("pieces reach across spaces")
    letter = re.compile(r"[^\W\d_]")
    if any(letter.match(x[0]) and not letter.match(x[1]) for x in neighbours):
        return lambda word: cut_apart(word, neighbours)
    pattern = re.compile(r"[\W\d_]+[^\W\d_]*|[^\W\d_]+")

    def of(word: str) -> list[str]:
        parts = pattern.findall(word)
        return parts if len(word) <= LONG else [y for x in parts for y in (cut_apart(x, neighbours) if len(x) > LONG else (x,))]

    return of


class _Words(dict):
    """Numbers words as they come. Word k has the segments flat[ends[k - 1] : ends[k]]: the numbers of segments that the
    dictionary has, and -1 - i for lacking[i]."""

    def __init__(self, known: list[str], table: PieceTable) -> None:
        super().__init__()
        self.number, self.segments = {w: k for k, w in enumerate(known)}, segments_of(table)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ends, self.flat, self.lacking = array("q"), array("i"), {}
        self[""] = 0
        self.ends.append(0)

    def __missing__(self, word: str) -> int:
        w, number = word.replace(" ", SPACE), self.number
        k = number.get(w)
        if k is not None:
            self.flat.append(k)
        else:
            for x in self.segments(w):
                k = number.get(x)
                self.flat.append(self.lacking.setdefault(x, -1 - len(self.lacking)) if k is None else k)
        self[word] = k = len(self)
        self.ends.append(len(self.flat))
        return k

    def packed(self, texts: list[str | None]) -> list[bytes | None]:
        """Of each text a digest, the numbers of its segments, with numbers of its own for those that the dictionary
        lacks, and their names; null without text."""
        if len(self) > KEPT_WORDS:
            self.forget()
        pack, of = zstandard.ZstdCompressor(level=3), self.__getitem__
        each = [np.fromiter(map(of, words), np.int64, len(words)) for words in (words_of(x) if x else () for x in texts)]
        ends, flat = np.frombuffer(self.ends, np.int64).copy(), np.frombuffer(self.flat, np.int32).copy() if self.flat else np.empty(0, np.int32)
        begins = np.append(0, ends[:-1])
        names = list(self.lacking)
        out: list[bytes | None] = []
        for x, words in zip(texts, each, strict=True):
            if not x:
                out.append(None)
                continue
            codes = flat[_ranges(begins[words], ends[words])]
            absent = codes < 0
            own, place = np.unique(-1 - codes[absent], return_inverse=True)
            codes[absent] = -1 - place
            planes = codes.view(np.uint8).reshape(-1, 4).T  # equal bytes together are packed better
            whole = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            out.append(pack.compress(np.array([len(codes), whole], np.uint64).tobytes() + planes.tobytes() + " ".join([names[i] for i in own]).encode("utf-8", "surrogatepass")))  # no segment has a space
        return out


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end, one range after the other."""
    size = ends - begins
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins - upto + size, size)


def _unpacked(packed: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, list[str], int]:
    """What _Words.packed() has packed: codes, names and digest."""
    raw = unpack.decompress(packed)
    n, whole = (int(x) for x in np.frombuffer(raw[:16], np.uint64))
    codes = np.frombuffer(raw[16 : 16 + 4 * n], np.uint8).reshape(4, n).T.copy().view(np.int32).ravel()
    return codes, raw[16 + 4 * n :].decode("utf-8", "surrogatepass").split(" ") if len(raw) > 16 + 4 * n else [], whole


def _give_back() -> None:
    """Returns freed memory to the system; a Python worker lives on after its task, beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _dictionary(docs: DataFrame, table: PieceTable, doc_id: str, text: str, sample_docs: int, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Frequent segments of a sample, the ends of their ids, and their ids, one after the other."""
    segments = segments_of(table)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for batch in batches:
            for x in batch["text"]:
                if x:
                    sums.update(words_of(x))
        parts: Counter = Counter()
        for w, k in sums.items():
            for x in segments(w.replace(" ", SPACE)):
                parts[x] += k
        if parts:
            yield pd.DataFrame({"word": list(parts), "n": np.array(list(parts.values()), np.int64)})

    share = min(1.0, sample_docs / max(1, docs.count()))
    part = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("text")
    often = part.mapInPandas(count, "word string, n long").filter(F.length("word").between(1, LONG)).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(size)
    often = materialize(often, "piece-dictionary")
    found = encode_words(often.select("word").repartition("word"), table)
    cuts = often.join(found.select("word", "cuts"), "word", "left").orderBy(F.desc("n"), "word").select("word", "cuts").toArrow()
    ids = _Ids(table)
    words = cuts["word"].to_pylist()
    lists = [ids.of(w, c) for w, c in zip(words, cuts["cuts"].to_pylist(), strict=True)]
    return words, np.cumsum([len(x) for x in lists], dtype=np.int64), np.fromiter(chain.from_iterable(lists), np.int32)


def encode(docs: DataFrame, table: PieceTable, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 20_000, dictionary_size: int = 200_000, verified: str | None = None) -> DataFrame:
    """All rows of `docs`, without the text, with piece_ids.

    `verified`: the name of a further column, whether the ids were found to decode to the text.
    """
    known, ends, flat = _dictionary(docs, table, doc_id, text, sample_docs, dictionary_size)
    sent_words, sent_ids = (docs.sparkSession.sparkContext.broadcast(x) for x in (known, (ends, flat)))
    chunks = max(1, math.ceil((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / CHUNK_BYTES))
    names = [c for c in docs.columns if c not in (text, "piece_ids")]
    chunk = F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).cast("int")

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _Words(sent_words.value, table)
        for batch in batches:
            yield pa.array(words.packed(batch.to_pylist()), pa.binary())
        words.forget()
        words.number.clear()
        _give_back()

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            found: set[tuple[int, str]] = set()
            for c, x in zip(batch["chunk"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                if x is not None:
                    found.update((c, w) for w in _unpacked(x, unpack)[1] if 2 <= len(w) <= LONG)
            to, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(words, pa.string())], ["chunk", "word"])

    rows = docs.select(chunk.alias("chunk"), F.struct(F.lit(0).alias("__lx_0"), *(F.col(f"`{c}`") for c in names)).alias("row"), packed(F.col(text)).alias("packed")).repartition("chunk")
    asked = rows.mapInArrow(lacking, "chunk int, word string").filter("word is not null and chunk is not null").repartition("word")
    words = asked.groupBy("word").agg(F.min("chunk").alias("some")).filter("some >= 0").select("word")  # the same columns as below are exchanged
    answers = asked.join(encode_words(words, table), "word").select("chunk", "word", "cuts")
    out_type = T.StructType([rows.schema["row"], T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])
    put = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_put_together(sent_ids, table, verified is not None), out_type)
    return put.select(*(F.col("row")[c].alias(c) for c in names if c != verified), "piece_ids", *([F.col("same").alias(verified)] if verified else []))


def _put_together(sent, table: PieceTable, verify: bool):
    def ids_of(packed: list[bytes | None], cuts: dict[str, int], ids: _Ids, texts: pa.Array) -> list[pa.Array]:
        """Lists of ids, and whether they decode to the texts. The answers are put after the dictionary, and then all
        codes are looked up at once."""
        ends, flat = sent.value
        unpack, first, own, lists = zstandard.ZstdDecompressor(), len(ends), {}, []
        each, sizes, digests = [], np.zeros(len(packed), np.int64), []
        for k, x in enumerate(packed):
            codes, digest = np.empty(0, np.int64), None
            if x is not None:
                codes, lacking, digest = _unpacked(x, unpack)
                codes = codes.astype(np.int64)
                if lacking:
                    at = []
                    for w in lacking:
                        if w not in own:
                            own[w] = first + len(own)
                            lists.append(ids.of(w, cuts.get(w)))
                        at.append(own[w])
                    absent = codes < 0
                    codes[absent] = np.array(at)[-1 - codes[absent]]
            each.append(codes)
            digests.append(digest)
            sizes[k] = len(codes)
        ends = np.append(ends, (ends[-1] if first else 0) + np.cumsum([len(x) for x in lists], dtype=np.int64))
        flat = np.append(flat, np.fromiter(chain.from_iterable(lists), np.int32))
        codes = np.concatenate(each) if each else np.empty(0, np.int64)
        begins = np.append(0, ends[:-1])[codes] if len(ends) else codes
        stops = ends[codes] if len(ends) else codes
        upto = np.append(0, np.cumsum(stops - begins))
        offsets = upto[np.append(0, np.cumsum(sizes))]
        values = flat[_ranges(begins, stops)]
        same = [None] * len(packed)
        if verify:
            whole, at = _decoded(values, offsets, texts)
            same = [d is None or xxhash.xxh3_64_intdigest(whole[a + 1 : b]) == d for d, a, b in zip(digests, at, at[1:], strict=False)]
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())), pa.array(same, pa.bool_())]

    def put(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, cuts, texts = _Ids(table), dict(zip(answers["word"].to_pylist(), answers["cuts"].to_pylist(), strict=True)), table.texts()
        parts = []
        for i in range(0, docs.num_rows, 250):  # bounds the arrays of numbers
            some = docs.slice(i, 250)
            parts.append(pa.Table.from_arrays([some["row"], *ids_of(some["packed"].to_pylist(), cuts, ids, texts)], ["row", "piece_ids", "same"]))
        return pa.concat_tables(parts) if parts else pa.Table.from_arrays([docs["row"], pa.array([], pa.list_(pa.int32())), pa.array([], pa.bool_())], ["row", "piece_ids", "same"])

    return put


def _decoded(ids: np.ndarray, ends: np.ndarray, texts: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of all ids, one after the other, and where in them the lists end that end at `ends`. The last of `texts`,
    which is empty, stands for ids that the table lacks."""
    last = len(texts) - 1
    taken = texts.take(pa.array(np.where((ids < 0) | (ids >= last), last, ids)))
    upto = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] if upto[-1] else b""), upto[ends].tolist()


def with_texts(encoded: DataFrame, table: PieceTable, ids: str = "piece_ids", name: str = "text") -> DataFrame:
    """All rows of `encoded` with the decoded text; ids that the table lacks are left out."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        texts = table.texts()
        for batch in batches:
            ends = np.append(0, np.cumsum([n or 0 for n in batch.value_lengths().to_pylist()], dtype=np.int64))
            whole, at = _decoded(batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False), ends, texts)
            yield pa.array([str(whole[a:b], "utf-8", "replace")[1:] for a, b in zip(at, at[1:], strict=False)], pa.string())

    return encoded.withColumn(name, decode(F.col(ids)))
