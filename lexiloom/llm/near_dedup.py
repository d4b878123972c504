"""MinHash near-duplicates by a signature-coordinate inverted join (operator 7).

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are classes; each class is taken once
from here on. A signature holds `COORDINATES` minima. A pair at the threshold or above agrees in `least_matches`
coordinates at least (but for a chance below `MISS`, by the binomial law), so it shares one of the first
`COORDINATES - least_matches + 1` coordinate-value pairs of each, in any fixed order. Classes are posted under that
prefix alone, in order of rising frequency, so that the long lists (of a passage that very many documents have) are
skipped, and a coordinate-value pair that only one class has costs nothing. Joins on these pairs deal the rows of a very
frequent one over many tasks.

Candidates come in two steps, neither of which emits all pairs of a list. First each list's most central member (that
whose coordinate-value pairs are the most frequent) is paired with all others; what holds on the full sets gives
components. Then, in lists where members of several components are left, members of different components are looked at
directly, each pair once: the collision count is a condition of the join, and so is the exact size of the intersection
where both have been compared with the same central member, as it follows from their (small) differences to it. Pairs
inside one component can't change the result.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. A row with a
null identifier is linked with nothing either. Repeated rows are one class. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.components import components
from lexiloom.llm.scratch import broadcast_if_small, join_dealt, materialize

COORDINATES = 32
VALUE_BITS = 40
MISS = 1e-6
SHORT, BLOCK = 24, 2000  # members of a list
_CHUNK = 2048
_KEPT_WORDS = 200_000


def least_matches(percent: int) -> int:
    """The highest number of agreeing coordinates that a pair at the threshold misses with a chance of MISS at most."""
    s, below = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        below += math.comb(COORDINATES, t) * s**t * (1 - s) ** (COORDINATES - t)
        if below > MISS:
            return max(1, t)
    return COORDINATES


class _WordHashes(dict):
    """Hashes of words met before; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than `width` make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for k in range(min(width, len(h))):
        out = _mix(out) + h[k : k + n]
    return np.unique(_mix(out))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for i in range(0, len(found), _CHUNK):
        part = found[i : i + _CHUNK, None] * by
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, part.min(axis=0))
    return least >> np.uint64(64 - VALUE_BITS)


def _profile(width: int) -> Column:
    """UDF: number of shingles, digest of the set, signature; both null for an empty set."""

    @F.pandas_udf("struct<n:long,digest:binary,sig:array<long>>")
    def profile(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, by = _WordHashes(), _multipliers()
        for batch in texts:
            rows = []
            for text in batch:
                found = shingles(text, width, hashes)
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, by).astype(np.int64)) if len(found) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "digest", "sig"])

    return profile


def _full_sets(width: int) -> Column:
    """UDF: the set, as longs."""

    @F.pandas_udf("array<long>")
    def full(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _WordHashes()
        for batch in texts:
            yield pd.Series([shingles(x, width, hashes).view(np.int64) for x in batch], dtype=object)

    return full


def _close_in_size(percent: int, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _matches(a: str, b: str) -> str:
    """The number of agreeing coordinates, as one expression without a lambda function, which would not be compiled."""
    return " + ".join(f"cast({a}[{k}] = {b}[{k}] as int)" for k in range(COORDINATES))


def postings(sets: DataFrame, matches: int) -> DataFrame:
    """(rep, n, central, key): the prefix of each class, without coordinate-value pairs that no other class has."""
    pairs = sets.select("rep", "n", F.posexplode("sig").alias("c", "v")).select("rep", "n", F.shiftleft(F.col("c").cast("long"), VALUE_BITS).bitwiseOR(F.col("v")).alias("key"))
    often = pairs.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = join_dealt(pairs, often, "key", "df", COORDINATES * sets.count(), "rep").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"), F.sum(F.log2("df")).alias("central"))
    alone = F.lit(COORDINATES) - F.size("keys")  # come first in the order
    prefix = F.slice("keys", 1, F.greatest(F.lit(0), F.lit(COORDINATES - matches + 1) - alone))
    return shared.select("rep", "n", "central", F.explode(prefix).alias("p")).select("rep", "n", "central", "p.key")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that hold on the full sets."""
    a, b = (full.withColumnsRenamed({"rep": x, "full": f"full_{x}"}) for x in "ab")
    both = F.size(F.array_intersect("full_a", "full_b"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("full_a") + F.size("full_b") - both)).select("a", "b")


def _full(ids: DataFrame, docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(rep, full): the full sets of the classes `ids` (rep), from one document of each."""
    texts = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).join(ids.distinct(), "rep", "left_semi")
    return materialize(texts.select("rep", _full_sets(width)("text").alias("full")).dropDuplicates(["rep"]), "near-full-sets")


def _central_pairs(posts: DataFrame, sets: DataFrame, matches: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rep, lead, rank): each list's most central member with the others; and (key, lead) of the lists of several."""
    lead = posts.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("neg"), "n")).alias("m"), F.count("*").alias("members")).filter("members > 1")
    lead = materialize(lead.select("key", (-F.col("m.neg")).alias("lead"), F.col("m.n").alias("lead_n"), F.col("m.central").alias("rank"), "members"), "near-leads")
    found = join_dealt(posts, lead, "key", "members", posts.count(), "rep").filter("rep <> lead").filter(_close_in_size(percent, "n", "lead_n")).select("rep", "lead", "rank").distinct()
    sig_a, sig_b = (sets.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in ("rep", "lead"))
    return found.join(sig_a, "rep").join(sig_b, "lead").filter(f"{_matches('sig_rep', 'sig_lead')} >= {matches}").select("rep", "lead", "rank"), lead


def _compared(central: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(rep, lead, link, home): whether a central pair holds on the full sets; where the lead is the member's home, the
    most central of its leads, `home` has the size of the lead's set and the difference of the two sets."""
    full = _full(central.select(F.explode(F.array("rep", "lead")).alias("rep")), docs, width, doc_id, text)
    best = central.groupBy("rep").agg(F.max(F.struct("rank", (-F.col("lead")).alias("neg"))).alias("best")).select("rep", (-F.col("best.neg")).alias("best"))
    sets = central.join(full, "rep").join(full.select(F.col("rep").alias("lead"), F.col("full").alias("lead_full")), "lead").join(best, "rep")
    both = F.size(F.array_intersect("full", "lead_full"))
    link = 100 * both >= percent * (F.size("full") + F.size("lead_full") - both)
    home = F.struct("lead", F.size("lead_full").alias("n"), F.array_except("lead_full", "full").alias("gone"), F.array_except("full", "lead_full").alias("more"))
    return materialize(sets.select("rep", "lead", link.alias("link"), F.when(F.col("lead") == F.col("best"), home).alias("home")), "near-compared")


def _pairs_across(posts: DataFrame, lead: DataFrame, sets: DataFrame, comps: DataFrame, homes: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b, sure): pairs of different components in one list that enough coordinates agree on.

    Leads have been compared with their lists before. Lists of up to SHORT members are joined with themselves; a longer
    one is dealt into blocks of about BLOCK members, and each two blocks are a task's work. If both members have the
    same home, the size of their intersection follows from their differences to it, and the pair is sure to hold.
    """
    named = posts.join(comps.withColumnsRenamed({"node": "rep", "component": "comp"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    total = posts.count()
    rest = join_dealt(named, lead.select("key", "lead", F.col("members").alias("all")), "key", "all", total, "rep").filter("rep <> lead").select("key", "rep", "n", "comp")
    rest = materialize(rest, "near-lists")
    mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("key", "members")
    rest = materialize(join_dealt(rest, materialize(mixed, "near-mixed-keys"), "key", "members", total, "rep"), "near-mixed-lists")
    detail = sets.select("rep", "sig").join(homes, "rep", "left")

    short = rest.filter(F.col("members") <= SHORT)
    a, b = (short.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "comp"))) for x in "ab")
    met = a.join(b, "key").filter(f"rep_a < rep_b and comp_a <> comp_b and {_close_in_size(percent, 'n_a', 'n_b')}").groupBy("rep_a", "rep_b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    of = lambda x: detail.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rep", "sig", "home")))
    met = met.join(of("a"), "rep_a").join(of("b"), "rep_b").filter(f"{_matches('sig_a', 'sig_b')} >= {matches}")
    sure = "coalesce(home_a.lead = home_b.lead, false)"
    both = "(home_a.n - size(home_a.gone) - size(home_b.gone) + size(array_intersect(home_a.gone, home_b.gone)) + size(array_intersect(home_a.more, home_b.more)))"
    met = met.filter(f"case when {sure} then 100 * {both} >= {percent} * (n_a + n_b - {both}) else true end")
    found = met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), F.expr(sure).alias("sure"))

    long = rest.filter(F.col("members") > SHORT)
    prefix = long.groupBy("rep").agg(F.array(*(F.coalesce(F.max(F.when(F.shiftright("key", VALUE_BITS) == k, F.col("key"))), F.lit(-1).cast("long")) for k in range(COORDINATES))).alias("pre"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = long.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("key", "i", "j", "own", "rep", "n", "comp")
    dealt = dealt.join(prefix, "rep").join(detail, "rep").select("key", "i", "j", "own", "rep", "n", "comp", "pre", "sig", "home.lead", F.col("home.n").alias("lead_n"), "home.gone", "home.more")
    by_blocks = dealt.groupBy("key", "i", "j").applyInPandas(_two_blocks(matches, percent), "a long, b long, sure boolean")
    return found.union(by_blocks)


def _two_blocks(matches: int, percent: int):
    """Pairs of one list between blocks i and j (or inside one), as numpy arrays of block by block."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        i, j = group["i"].iat[0], group["j"].iat[0]
        at = int(group["key"].iat[0]) >> VALUE_BITS
        left, right = np.flatnonzero(group["own"] == i), np.flatnonzero(group["own"] == j)
        sig, pre = np.stack(group["sig"].to_list()), np.stack(group["pre"].to_list())
        rep, n, comp = (group[c].to_numpy() for c in ("rep", "n", "comp"))
        lead, lead_n = (group[c].fillna(-1).to_numpy(np.int64) for c in ("lead", "lead_n"))
        has_lead = group["lead"].notna().to_numpy()
        as_set = lambda c: [frozenset(x.tolist()) if x is not None and not isinstance(x, float) else frozenset() for x in group[c]]
        gone, more = as_set("gone"), as_set("more")
        out_a, out_b, out_sure = [], [], []
        for x in left:  # a row of the block at a time
            y = right[right > x] if i == j else right
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            earlier = (pre[y, :at] == pre[x, :at]) & (pre[x, :at] >= 0)  # then an earlier list has this pair
            y = y[~earlier.any(axis=1)]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= matches]
            for z in y.tolist():
                sure = bool(has_lead[x] and has_lead[z] and lead[x] == lead[z])
                if sure:
                    both = lead_n[x] - len(gone[x]) - len(gone[z]) + len(gone[x] & gone[z]) + len(more[x] & more[z])
                    if 100 * both < percent * (n[x] + n[z] - both):
                        continue
                out_a.append(min(rep[x], rep[z]))
                out_b.append(max(rep[x], rep[z]))
                out_sure.append(sure)
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64), "sure": np.array(out_sure, bool)})

    return pairs


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: (doc_id, n_shingles, component_id, kept).

    Linked are documents with 100 * intersection >= percent * union of their sets of `width`-word shingles;
    component_id is the smallest identifier reachable by links, and kept says whether it is the document's own.
    """
    matches = least_matches(percent)
    profiled = docs.select(F.col(doc_id).alias("doc_id"), _profile(width)(F.col(text)).alias("p")).select("doc_id", "p.*")
    base = materialize(profiled, "near-profiles")
    linkable = base.filter("n > 0 and doc_id is not null")
    sets = materialize(linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-sets")
    posts = materialize(postings(sets, matches), "near-postings")
    central, lead = _central_pairs(posts, sets, matches, percent)
    compared = _compared(materialize(central, "near-central"), docs, width, percent, doc_id, text)
    links = compared.filter("link").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    homes = compared.filter("home is not null").select("rep", "home")
    comps = components(links)
    across = materialize(_pairs_across(posts, lead, sets, comps, homes, matches, percent), "near-across")
    links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across.filter("sure").select("a", "b"))
    unsure = across.filter("not sure").select("a", "b")
    if not unsure.isEmpty():
        links = links.union(_confirmed(unsure, _full(unsure.select(F.explode(F.array("a", "b")).alias("rep")), docs, width, doc_id, text), percent))
    comps = components(links).withColumnRenamed("node", "rep")
    named = sets.select("digest", "rep").join(comps, "rep", "left").select("digest", F.coalesce("component", "rep").alias("found"))
    out = base.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"), F.coalesce(F.col("found") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are kept, with its columns; rows that repeat a kept identifier stay with it, so that each
    group keeps a document even where one identifier stands on different texts."""
    marked = near_duplicates(docs, doc_id, text, width, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = marked.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__lx_gone"))
    return docs.join(broadcast_if_small(materialize(gone, "near-gone")), F.col(doc_id) == F.col("__lx_gone"), "left_anti")
