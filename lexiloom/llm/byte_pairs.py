"""Byte-level BPE encoding and decoding, long texts by concatenation of encoded parts (operator 11).

A text up to `part` characters is encoded where it lies. A longer one is cut into parts of so many characters, wherever
that falls, in words too; parts are encoded in parallel and joined two by two, as a tree. At a join the text around it is
encoded anew, in windows that grow until the window's tokens meet those of both sides.

That is exact. A sequence of tokens is what byte-pair merging makes of a pretoken if any two neighbours in it are what
merging makes of these two (a token has one merge, so merges come in order of rank, and the first one across a boundary
would come in the two alone as well); so two encodings that share a token can be spliced there. And pretokens depend on
what follows by a few characters only: MARGIN bytes before an end that was cut, or after a start that was, a boundary
between pretokens is as in the whole text, or a run of one kind of characters goes on as it does there. Tokens may never
meet (`aaaa..` in another phase): then the window ends with the part. All tokens have their bytes, so windows need no texts.

Defined results: null is empty, and empty texts have no ids. Special tokens in a text become their ids. Equal long texts
are encoded once. A column named `ids` is replaced, other columns and repeated rows pass through, whatever their names.
Identifiers unknown to the vocabulary decode to nothing; bytes that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import join_dealt, materialize

#: Characters of a part.
PART = 32_768
#: Bytes at a cut end that pretokens may depend on: the longest special token and more, in characters of four bytes.
MARGIN = 64
#: The first window's tokens at each side of a join.
WINDOW = 64
#: Marks a token that begins a pretoken.
STARTS = np.uint32(1 << 31)
#: How the vocabulary's pretokenizer splits texts, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def letters_of_bytes() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be seen, else the next from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A tokenizer's file (JSON): byte-level BPE without normaliser. Sent to the tasks as text."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not spec["normalizer"]
        if not plain or len(model["vocab"]) != 256 + len(model["merges"]):
            raise ValueError("only byte-level BPE with a merge for each token is known")
        spec |= {"truncation": None, "padding": None, "post_processor": None}
        self.text = json.dumps(spec)
        byte = {x: b for b, x in enumerate(letters_of_bytes())}
        self.ranks = {bytes(byte[x] for x in token): k for token, k in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read on the driver; executors needn't have the file."""
        with open(path, encoding="utf-8") as f:
            return Vocabulary(f.read())

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes of each id, and last an empty entry for ids that there aren't."""
        known = {k: x for x, k in self.ranks.items()} | {k: x.encode() for x, k in self.special.items()}
        return [known.get(k, b"") for k in range(max(known) + 1)] + [b""]


class Encoder:
    """Encodes texts, and joins encoded parts; made in the task.

    Encoded parts are arrays of ids; the highest bit says that a pretoken begins.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.tokens = np.array(vocabulary.bytes_of_ids(), object)
        self.size = np.array([len(x) for x in self.tokens], np.int64)
        first = np.array([x[0] if x else 0 for x in self.tokens], np.int64)
        self.whole = (first & 0xC0) != 0x80  # begins with a character
        self.apostrophe = first == ord("'")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.vocabulary.text)

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("lexiloom", pat_str=PATTERN, mergeable_ranks=self.vocabulary.ranks, special_tokens=self.vocabulary.special)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text of a part or less; the pretokens aren't told."""
        return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)

    def part(self, text: str) -> np.ndarray:
        """Ids with marks of pretokens."""
        found = self.library.encode(text, add_special_tokens=False)
        out = np.array(found.ids, np.uint32)
        if len(out):
            word = np.array(found.word_ids, np.int64)
            out[np.append(True, word[1:] != word[:-1])] |= STARTS
        return out

    def bytes_of(self, part: np.ndarray) -> bytes:
        return b"".join(self.tokens[part & ~STARTS])

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of the text of both, of the encodings of each."""
        n = WINDOW
        while True:
            a, m = self._begin(left, n), self._end(right, n)
            new = self.part((self.bytes_of(left[a:]) + self.bytes_of(right[:m])).decode("utf-8"))
            starts = bool(left[a] & STARTS)
            if not starts:
                new[0] &= ~STARTS  # goes on with a pretoken of the left side
            if starts or new[0] == left[a]:
                met = self._meet(new, int(self.size[left[a:] & ~STARTS].sum()), right, m)
                if met is not None:
                    return np.concatenate([left[:a], new[: met[0]], right[met[1] :]])
            n *= 2

    def _begin(self, left: np.ndarray, n: int) -> int:
        """A token `n` or more before the end where a window may begin: the first one, one that begins a pretoken, or one
        well inside a run; MARGIN before the end."""
        upto = min(len(left), 4 * n + 4 * MARGIN)
        ids = left[len(left) - upto :]
        own = ids & ~STARTS
        at = np.cumsum(self.size[own]) - self.size[own]
        marked = (ids & STARTS) != 0
        run = at - np.maximum.accumulate(np.where(marked, at, -1))  # from the last mark; the mark itself has 0
        known = np.maximum.accumulate(marked) | (at >= MARGIN)
        fits = marked | (known & (run >= MARGIN) & self.whole[own] & ~self.apostrophe[own])
        fits &= (at <= at[-1] + self.size[own[-1]] - MARGIN) & (np.arange(upto) <= upto - n)
        found = np.flatnonzero(fits)
        return len(left) - upto + int(found[-1]) if len(found) else (0 if upto == len(left) else self._begin(left, 2 * n))

    def _end(self, right: np.ndarray, n: int) -> int:
        """How many tokens of the right side a window of `n` or more takes; it ends with a character."""
        m = n
        while m < len(right) and not self.whole[right[m] & ~STARTS]:
            m += 1
        return min(m, len(right))

    def _meet(self, new: np.ndarray, join: int, right: np.ndarray, m: int) -> tuple[int, int] | None:
        """Places in `new` and `right` from which the right side holds; `join`: where in bytes the right side begins."""
        a, b = self.size[new & ~STARTS], self.size[right[:m] & ~STARTS]
        at_a, at_b = np.cumsum(a) - a, np.cumsum(b) - b + join
        end = int(at_b[-1] + b[-1]) if m else join
        same, i, j = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        if len(same):
            s_a, s_b = (new & STARTS) != 0, (right[:m] & STARTS) != 0
            run = lambda at, s: at - np.append(-MARGIN, np.maximum.accumulate(np.where(s, at, -MARGIN))[:-1])  # noqa: E731  from the last mark before
            inside = (run(at_a, s_a)[i] >= MARGIN) & (run(at_b, s_b)[j] >= MARGIN) & ~s_a[i] & ~s_b[j] & (i > 0) & (j > 0) & self.whole[new[i] & ~STARTS]
            inside &= (new[i - 1] & ~STARTS) == (right[j - 1] & ~STARTS)
            fits = (s_a[i] & s_b[j]) | inside
            if m < len(right):
                fits &= same <= end - MARGIN
            found = np.flatnonzero(fits)
            if len(found):
                return int(i[found[0]]), int(j[found[0]])
        return (len(new), m) if m == len(right) else None


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", part: int = PART) -> DataFrame:
    """All rows of `docs`, without the text, with `ids`: the tokens' ids as little-endian unsigned 32-bit integers."""
    spark, names = docs.sparkSession, [c for c in docs.columns if c not in (text, "ids")]
    sent = spark.sparkContext.broadcast(vocabulary)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(F.lit(0).alias("__lx_0"), *(F.col(f"`{c}`") for c in names)).alias("row")
    total, longest = docs.agg(F.count("*"), F.max(F.length(body))).first()

    @F.arrow_udf("binary")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Encoder(sent.value)
        for batch in batches:
            yield pa.array([_packed(of.ids(x)) for x in batch.to_pylist()], pa.binary())

    @F.arrow_udf("binary")
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Encoder(sent.value)
        for batch in batches:
            yield pa.array([_packed(of.part(x)) for x in batch.to_pylist()], pa.binary())

    @F.arrow_udf("binary")
    def joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of = Encoder(sent.value)
        for lefts, rights in batches:
            out = []
            for a, b in zip(lefts, rights, strict=True):
                a, b = a.as_py(), b.as_py()
                out.append(a if b is None else _packed(of.join(np.frombuffer(a, "<u4").astype(np.uint32), np.frombuffer(b, "<u4").astype(np.uint32))))
            yield pa.array(out, pa.binary())

    @F.arrow_udf("binary")
    def bare(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_packed(np.frombuffer(x, "<u4") & ~STARTS) for x in batch.to_pylist()], pa.binary())

    short = docs.filter(F.length(body) <= part).select(row, whole(body).alias("ids"))
    columns = [F.col("row")[c].alias(c) for c in names]
    if (longest or 0) <= part:
        return short.select(*columns, "ids")
    long = docs.filter(F.length(body) > part).select(row, F.sha2(body, 256).alias("key"), body.alias("body"))
    cut = long.select("key", F.posexplode(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{part}}}"), F.lit(0))).alias("at", "piece"))
    once = cut.groupBy("key", "at").agg(F.first("piece").alias("piece"), F.count("*").alias("copies"))  # copies of a text meet before the exchange
    tree = once.select("key", "at", "copies", parts("piece").alias("ids"))
    for _ in range(math.ceil(math.log2(math.ceil(longest / part)))):
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("ids")))
        two = tree.groupBy("key", F.floor(F.col("at") / 2).alias("at")).agg(F.max("copies").alias("copies"), side(0).alias("left"), side(1).alias("right"))
        tree = two.select("key", "at", "copies", joined("left", "right").alias("ids"))
    done = materialize(tree.select("key", "copies", bare("ids").alias("ids")), "byte-pairs")
    placed = join_dealt(long.select("row", "key", F.monotonically_increasing_id().alias("deal")), done, "key", "copies", total, "deal")
    return short.union(placed.select("row", "ids")).select(*columns, "ids")


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of packed ids, special tokens included; null has none."""
    known = vocabulary.bytes_of_ids()

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        texts, last = pa.array(known, pa.large_binary()), len(known) - 1
        for batch in batches:
            ends = np.cumsum([0, *((n or 0) // 4 for n in _lengths(batch))])
            every = np.frombuffer(b"".join(x or b"" for x in batch.to_pylist()), "<u4").astype(np.int64)
            taken = texts.take(pa.array(np.where(every < last, every, last)))
            upto = np.frombuffer(taken.buffers()[1], np.int64)[: len(every) + 1] if len(every) else np.zeros(1, np.int64)
            whole = memoryview(taken.buffers()[2]) if upto[-1] else memoryview(b"")
            at = upto[ends].tolist()
            yield pa.array([str(whole[a:b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)], pa.string())

    return of(ids)


def _lengths(batch: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(batch).to_pylist()
