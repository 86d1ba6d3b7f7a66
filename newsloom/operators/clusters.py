"""Topic clusters: articles whose TF-IDF vectors have a cosine of at least a
threshold, joined transitively.

The similarity join is exact. At the thresholds in use most texts of a language share
words enough that a join on words makes nearly all pairs as rows, so none is made:
1. Articles with equal word counts are one vector, so copies cost one row.
2. Vectors are packed into blocks of bounded size, one row each, categories side by side,
   and every two blocks meet in a task that reads them from the stored table (a nested
   loop over blocks, no shuffle).
3. A meeting drops the vectors that cannot reach the threshold with what they share with
   the other block. Of the words that most vectors of both blocks have it multiplies
   projections to a few directions; the lengths of what is left of two vectors bound the
   rest of their product. All other words go through the postings of one block. Only the
   pairs which that leaves possible are multiplied in full.
4. Clusters need links, not all pairs: a block is joined by itself first, and pairs that
   are joined already are not looked at. Links of the blocks' components leave a task.
   Pairs within rounding of the threshold get their cosine in one fixed way.
Memory is bounded by two blocks and disk by the vectors; the work is still the square of
the number of distinct vectors, at a small cost for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import text as t
from newsloom.operators.components import connected_components, join
from newsloom.operators.keywords import corpus_terms
from newsloom.operators.ranking import keep_first
from newsloom.session import cut

SLACK = 1e-5            # far above the rounding of a sum of single-precision products
BLOCK = 8192            # vectors of a block
POSTINGS = 3_000_000    # and its words
GROUPS = 64             # categories are told apart by so many hashes
STRIP, PRODUCTS = 64, 2_000_000   # rows and products worked on at once
DENSE, COMMON = 4096, 0.001       # columns of a matrix; share of all pairs that a word must touch to be one
RANK = 64               # directions of the projection


# --- vectors -----------------------------------------------------------------

COUNTED = "id long, group int, tokens array<string>, tfs array<int>, firsts array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each row, in order, with frequency and first place."""
    for batch in batches:
        words = batch.column("words")
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        keys, first, count = np.unique(row * max(len(rank), 1) + rank[coded.indices.to_numpy(zero_copy_only=False)],
                                       return_index=True, return_counts=True)
        row, code = np.divmod(keys, max(len(rank), 1))
        offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
        first -= (np.cumsum(sizes) - sizes)[row]
        tokens = coded.dictionary.take(order).take(pa.array(code))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (tokens, pa.array(count.astype(np.int32)), pa.array(first.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group"), *lists], names=[x.split()[0] for x in COUNTED.split(", ")])


def word_bags(a: DataFrame, chars: int | None = None, stop_words=fv.CLUSTER_STOP_WORDS) -> DataFrame:
    """(id, group, tokens, tfs, firsts, hashes, words, bag), one row per article: its
    distinct words in order, and a digest of them and their frequencies."""
    words = t.kept_tokens(t.tokens(t.article_text(chars)), stop_words, drop_digits=False)
    group = F.pmod(F.xxhash64("category"), F.lit(GROUPS)).cast("int") if "category" in a.columns else F.lit(0)
    counted = a.select("id", group.alias("group"), words.alias("words")).mapInArrow(_counted, COUNTED)
    return cut(counted.withColumns({"hashes": F.transform("tokens", lambda x: F.xxhash64(x)), "words": F.size("tokens"),
                                    "bag": F.md5(F.to_json(F.struct("tokens", "tfs")))}))


def term_rows(bags: DataFrame, *keep: str) -> DataFrame:
    """(id, token, tf, pos) of word bags, with the columns `keep`."""
    return bags.select("id", *keep, F.explode(F.arrays_zip("tokens", "tfs", "firsts")).alias("_t")).select(
        "id", *keep, F.col("_t.tokens").alias("token"), F.col("_t.tfs").cast("bigint").alias("tf"), F.col("_t.firsts").alias("pos"))


# --- blocks ------------------------------------------------------------------

# what only tasks read is bytes, which cost nothing to bring to them
PACKED = "block long, ids array<long>, sizes binary, tokens array<long>, held array<long>, codes binary, tfs binary"
WEIGHED = "block long, ids array<long>, sizes binary, tokens binary, idf binary, codes binary, tfs binary, norms binary, roots array<int>"
BYTES = {"sizes": np.int32, "tokens": np.int64, "idf": np.float64, "codes": np.int32, "tfs": np.int32, "norms": np.float64}


def _one_row(schema: str, block, *columns: np.ndarray) -> pa.Table:
    names, types = zip(*(x.split() for x in schema.split(", ")))
    cells = [pa.array([x.tobytes()], pa.binary()) if kind == "binary" else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
             for x, kind in zip(columns, types[1:])]
    return pa.Table.from_arrays([pa.array([block], pa.int64()), *cells], names=list(names))


def _values(cell: pa.Scalar, name: str) -> np.ndarray:
    """The array in a cell of a block."""
    if isinstance(cell, pa.BinaryScalar):
        return np.frombuffer(cell.as_buffer(), dtype=BYTES[name])
    return cell.values.to_numpy(zero_copy_only=False)


def _pack(rows: pa.Table) -> pa.Table:
    """One row of a block's vectors, long ones first: its distinct words in order, how many
    articles have each, and the words of its vectors as places in that list."""
    rows = rows.take(pc.sort_indices(rows, [("words", "descending"), ("id", "ascending")]))
    words, tfs = (rows.column(c).combine_chunks() for c in ("hashes", "tfs"))
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    tokens, codes = np.unique(words.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    copies = rows.column("copies").to_numpy()
    held = np.bincount(codes, np.repeat(copies, sizes), len(tokens)).astype(np.int64)
    return _one_row(PACKED, rows.column("block")[0].as_py(), rows.column("id").to_numpy(), sizes.astype(np.int32), tokens, held,
                    codes.astype(np.int32), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int32))


def _weigh(articles: int, threshold: float):
    """Blocks (PACKED) and the words of theirs that several articles have (block, token, df)
    to blocks of weights tf * (ln((N + 1) / (df + 1)) + 1) over the length of the vector. Words
    of one article count in the length only. `roots` are the block's own components."""

    def weigh(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, tokens, codes, tfs = (_values(rows.column(c)[0], c) for c in ("ids", "sizes", "tokens", "codes", "tfs"))
        df = np.ones(len(tokens))
        df[np.searchsorted(tokens, answers.column("token").to_numpy())] = answers.column("df").to_numpy()
        idf = np.log((articles + 1) / (df + 1)) + 1
        row = np.repeat(np.arange(len(ids)), sizes)
        norms = np.sqrt(np.bincount(row, (tfs * idf[codes]) ** 2, len(ids)))
        shared = df > 1
        kept = shared[codes]
        block = {"ids": ids, "sizes": np.bincount(row[kept], minlength=len(ids)).astype(np.int32), "tokens": tokens[shared], "idf": idf[shared],
                 "codes": (np.cumsum(shared) - 1)[codes[kept]].astype(np.int32), "tfs": tfs[kept], "norms": norms}
        label = _Meeting(block, None, threshold).joined()
        # a component is named by its smallest id
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        root = np.empty(len(ids), dtype=np.int32)
        named = np.flatnonzero(ids == least[label])
        root[label[named]] = named
        return _one_row(WEIGHED, rows.column("block")[0].as_py(), *block.values(), root[label])

    return weigh


def _blocks(bags: DataFrame, first: DataFrame, articles: int, threshold: float, crowd: int) -> DataFrame:
    """The blocks (WEIGHED) of the bags whose article is the first one to have it."""
    spark = bags.sparkSession
    reps = bags.join(first.select(F.col("rep").alias("id"), F.col("_n").alias("copies")), "id")
    sizes = {r["group"]: (r["n"], r["words"]) for r in reps.groupBy("group").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    share = np.zeros(GROUPS)
    for group, (n, words) in sizes.items():
        share[group] = max(n / crowd, words / POSTINGS)
    # enough blocks for all cores to have pairs of them, where they do not get tiny
    spread = min(int((8 * spark.sparkContext.defaultParallelism) ** 0.5), sum(n for n, _ in sizes.values()) // 1024)
    blocks = max(math.ceil(share.sum()), spread, 1)
    share *= blocks / max(share.sum(), 1e-9)
    at, wide = (F.array(*[F.lit(float(x)) for x in values])[F.col("group")] for values in (np.cumsum(share) - share, share))
    place = at + wide * (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20))
    parts = min(blocks, 2000)
    dealt = reps.select(F.least(F.floor(place), F.lit(blocks - 1)).alias("block"), "id", "copies", "words", "hashes", "tfs").repartition(parts, "block")
    packed = cut(dealt.groupBy("block").applyInArrow(_pack, PACKED))
    held = packed.select("block", F.explode(F.arrays_zip("tokens", "held")).alias("_x")).select(
        "block", F.col("_x.tokens").alias("token"), F.col("_x.held").alias("held"))
    answers = held.withColumn("df", F.sum("held").over(Window.partitionBy("token"))).filter("df > 1").select("block", "token", "df")
    return cut(packed.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(
        _weigh(articles, threshold), WEIGHED))


def _links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): links of the components of every two blocks."""
    columns = blocks.columns
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in columns])
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in columns])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = ({c: _values(batch.column(f"{side}_{c}")[row], c) for c in columns if c != "block"} for side in "ab")
                ids = np.concatenate([one["ids"], two["ids"]])
                before = np.concatenate([one["roots"], two["roots"] + len(one["ids"])])
                label = _Meeting(one, two, threshold).joined()
                tied = np.flatnonzero((before == np.arange(len(ids))) & (label != before))
                yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], names=["src", "dst"])

    return left.join(right.hint("shuffle_replicate_nl"), F.col("a_block") < F.col("b_block")).mapInArrow(walk, "src long, dst long")


# --- two blocks --------------------------------------------------------------

class _Meeting:
    """Two blocks with their components, or one block with itself, joined by their
    similar pairs. Nodes are the vectors of the first block, then those of the second."""

    def __init__(self, one: dict, two: dict | None, threshold: float):
        self.alone, self.threshold = two is None, threshold
        self.blocks = (one, one) if two is None else (one, two)
        n = len(one["ids"])
        self.label = np.arange(n) if two is None else np.concatenate([one["roots"], two["roots"] + n]).astype(np.int64)
        self.shift = 0 if two is None else n

    def _shared(self) -> tuple[list, int]:
        """(row, code, weight) of the words that both blocks have."""
        tokens = [b["tokens"] for b in self.blocks]
        shared = tokens[0] if self.alone else np.intersect1d(*tokens, assume_unique=True)
        sides = []
        for b in self.blocks[:1] if self.alone else self.blocks:
            place = np.full(len(b["tokens"]), -1)
            place[np.searchsorted(b["tokens"], shared)] = np.arange(len(shared))
            code = place[b["codes"]]
            kept = code >= 0
            row = np.repeat(np.arange(len(b["ids"])), b["sizes"])[kept]
            sides.append((row, code[kept], b["tfs"][kept] * b["idf"][b["codes"][kept]] / b["norms"][row]))
        return sides * (2 if self.alone else 1), len(shared)

    def _within_reach(self, side: tuple, other: tuple, n: int, words: int) -> np.ndarray:
        """Rows whose product with the other block's rows can be the threshold: by their
        lengths, and by the greatest weight of each word there."""
        row, code, w = side
        if not len(other[0]):
            return np.zeros(n, dtype=bool)
        length = np.sqrt(np.bincount(row, w * w, n)) * math.sqrt(np.bincount(other[0], other[2] * other[2]).max())
        most = np.zeros(words)
        np.maximum.at(most, other[1], other[2])
        return np.minimum(length, np.bincount(row, w * most[code], n)) >= self.threshold - SLACK

    def joined(self) -> np.ndarray:
        """Of each node, one node of its component."""
        sides, words = self._shared()
        rows = [np.arange(len(b["ids"])) for b in self.blocks]
        for k in (0,) if self.alone else (0, 1):
            near = self._within_reach(sides[k], sides[1 - k], len(rows[k]), words)
            row, code, w = sides[k]
            kept = near[row]
            sides[k] = (np.cumsum(near) - 1)[row[kept]], code[kept], w[kept]
            rows[k] = rows[k][near]
            if self.alone:
                sides[1], rows[1] = sides[0], rows[0]
        if len(rows[0]) and len(rows[1]):
            self._walk(sides, rows, words)
        return self.label

    def _walk(self, sides: list, rows: list, words: int) -> None:
        n, n2 = (len(x) for x in rows)
        nodes, nodes2 = rows[0], rows[1] + self.shift
        touched = np.bincount(sides[0][1], minlength=words) * np.bincount(sides[1][1], minlength=words)
        common = np.argsort(-touched, kind="stable")[:DENSE]
        common = common[touched[common] > COMMON * n * n2]
        column = np.full(words, -1)
        column[common] = np.arange(len(common))

        def split(count, row, code, w):
            at = column[code]
            inside, outside = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            matrix = np.zeros((count, len(common)), dtype=np.float32)
            matrix[row[inside], at[inside]] = w[inside]
            return matrix, row[outside], code[outside], w[outside]

        dense, row, code, w = split(n, *sides[0])
        dense2, row2, code2, w2 = (dense, row, code, w) if self.alone else split(n2, *sides[1])
        order = np.argsort(code2, kind="stable")
        row2, code2, w2 = row2[order], code2[order], w2[order]
        begin = np.searchsorted(row, np.arange(n + 1))
        small, small2 = _projections(dense, dense2)

        def columns(at: np.ndarray) -> tuple:
            """Rows of the second block to compare with, and the postings of their words."""
            place = np.full(n2, -1)
            place[at] = np.arange(len(at))
            kept = np.flatnonzero(place[row2] >= 0)
            count = np.bincount(code2[kept], minlength=words)
            return at, small2[at], place[row2[kept]], w2[kept], count, np.cumsum(count) - count

        # rows of the largest component are compared with what is not in it, and
        # a block with itself only with the rows still to come
        begun = columns(np.arange(n2))
        sets, largest, waiting = [begun, begun], -1, np.ones(n, dtype=bool)
        while waiting.any():
            before, largest = largest, int(np.bincount(self.label).argmax())
            if before < 0 or self.label[before] != largest:
                sets[1] = begun
            todo = np.flatnonzero(waiting)
            within = self.label[nodes[todo]] == largest
            inner = int(within.sum() >= STRIP or within.all())
            mine = todo[within if inner else ~within][:STRIP]
            needed = np.ones(len(sets[inner][0]), dtype=bool)
            if inner:
                needed &= self.label[nodes2[sets[inner][0]]] != largest
            if self.alone:
                needed &= waiting[sets[inner][0]]
            if needed.mean() < 0.85 if len(needed) else False:
                sets[inner] = columns(sets[inner][0][needed])
            at, few, row3, w3, count, start = sets[inner]
            if not len(at):
                waiting[mine] = False
                continue
            while True:
                sizes = begin[mine + 1] - begin[mine]
                each = np.arange(sizes.sum()) + np.repeat(begin[mine] - np.cumsum(sizes) + sizes, sizes)
                line, times = np.repeat(np.arange(len(mine)) * len(at), sizes), count[code[each]]
                if len(mine) == 1 or times.sum() <= PRODUCTS:
                    break
                mine = mine[:len(mine) // 2]
            met = np.flatnonzero(times)
            each, line, times = each[met], line[met], times[met]
            other = np.repeat(start[code[each]] - np.cumsum(times) + times, times)
            other += np.arange(len(other))
            places = np.repeat(line, times)
            places += row3[other]
            product = np.repeat(w[each], times)
            product *= w3[other]
            rare = np.bincount(places, product, len(mine) * len(at))
            most = (small[mine] @ few.T).ravel()
            most += rare
            # twice the slack: a bound is rounded, too
            hit = np.flatnonzero(most >= self.threshold - 2 * SLACK)
            i, j = np.divmod(hit, len(at))
            apart = self.label[nodes[mine[i]]] != self.label[nodes2[at[j]]]
            i, j, hit = i[apart], at[j[apart]], hit[apart]
            cosine = most[hit] if small is dense else rare[hit] + _products(dense[mine], dense2, i, j)
            i, j = nodes[mine[i]], nodes2[j]
            clear = cosine >= self.threshold + SLACK
            join(self.label, i[clear], j[clear])
            close = ~clear & (cosine >= self.threshold - SLACK)
            close[close] = self.label[i[close]] != self.label[j[close]]
            if close.any():
                join(self.label, *_exact(self, (i[close], j[close]), self.threshold))
            waiting[mine] = False


def _projections(dense: np.ndarray, dense2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products bound those of the given ones from above: their places in a few
    directions, and the length of what is left. Rows of few columns are given back."""
    if dense.shape[1] <= 3 * RANK:
        return dense, dense2
    part = np.concatenate([x[:: len(x) // 1024 + 1] for x in (dense, dense2)])
    basis = np.random.default_rng(0).standard_normal((len(part), RANK), dtype=np.float32)
    basis = np.linalg.qr(part.T @ basis)[0]
    for _ in range(2):
        basis = np.linalg.qr(part.T @ (part @ basis))[0]
    out = []
    for x in (dense, dense2):
        places = x @ basis
        left = np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", places, places)
        out.append(np.column_stack([places, np.sqrt(np.maximum(left, 0) + SLACK)]))
    return out[0], out[1]


def _products(strip: np.ndarray, dense2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a strip with rows j: one by one, or all of them with the
    rows asked for where these are many."""
    columns, at = np.unique(j, return_inverse=True)
    if len(i) > 3 * len(columns):
        return (strip @ dense2[columns].T)[i, at]
    return np.concatenate([np.einsum("ij,ij->i", strip[i[k:k + 512]], dense2[j[k:k + 512]]) for k in range(0, len(i), 512)] or [np.zeros(0)])


def _exact(meeting: _Meeting, pairs: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes that reach the threshold, by cosines of double precision."""

    def vector(side: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        b = meeting.blocks[side]
        stop = int(b["sizes"][:row + 1].sum())
        mine = slice(stop - int(b["sizes"][row]), stop)
        return b["tokens"][b["codes"][mine]], b["tfs"][mine] * b["idf"][b["codes"][mine]] / b["norms"][row]

    good = []
    for i, j in zip(*pairs):
        (x, w), (y, w2) = vector(0, i), vector(1, j - meeting.shift)
        _, at, at2 = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        good.append(math.fsum(w[at] * w2[at2]) >= threshold)
    return pairs[0][good], pairs[1][good]


# --- clusters ----------------------------------------------------------------

def cluster_members(a: DataFrame, threshold: float = 0.4, chars: int | None = None,
                    stop_words=fv.CLUSTER_STOP_WORDS, crowd: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, bags): members are (id, cluster) of clusters of at least two,
    named by their first id; bags are the word bags for further use."""
    bags = word_bags(a, chars, stop_words)
    articles = bags.count()
    # equal bags of words share one vector
    filled = bags.filter("words > 0").select("id", "bag")
    first = filled.groupBy("bag").agg(F.min("id").alias("rep"), F.count("*").alias("_n"))
    blocks = _blocks(bags, first, articles, threshold, crowd)
    names = connected_components(_links(blocks, threshold)).withColumnsRenamed({"node": "root"})
    own = blocks.select("ids", F.explode(F.arrays_zip("ids", "roots")).alias("_x")).select(
        F.col("_x.ids").alias("rep"), F.get("ids", F.col("_x.roots")).alias("root"))
    several = own.groupBy("root").agg((F.count("*") > 1).alias("_several"))
    roots = own.join(several, "root").join(names, "root", "left").select(
        "rep", F.coalesce("component", "root").alias("cluster"), (F.col("_several") | F.col("component").isNotNull()).alias("_linked"))
    # a bag of copies is a cluster by itself; a lone article is none
    kept = first.join(roots, "rep").filter((F.col("_linked") | (F.col("_n") > 1)) & F.lit(articles >= 3))
    return filled.join(kept.select("bag", "cluster"), "bag").select("id", "cluster"), bags


def cluster_articles(a: DataFrame, threshold: float = 0.4, chars: int | None = None, top: int = 20,
                     stop_words=fv.CLUSTER_STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): the largest clusters with label, size and five
    keywords, and the membership table (cluster, id, article_id)."""
    members, bags = cluster_members(a, threshold, chars, stop_words)
    members = cut(members)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(top)
    picked = cut(members.join(F.broadcast(sizes), "cluster"))
    titles = picked.join(a.select("id", "article_id", "title"), "id")
    label = titles.groupBy("cluster").agg(
        F.min(F.struct(F.length("title").alias("n"), F.col("title"))).alias("t"))
    counts = corpus_terms(term_rows(bags.join(picked.select("id", "cluster"), "id"), "cluster"), "id", "cluster")
    words = keep_first(counts, ["cluster"], [F.desc("n"), F.asc("first_doc"), F.asc("first_pos")], 5).groupBy(
        "cluster").agg(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_doc", "first_pos", "token"))),
            lambda x: x["token"]).alias("keywords"))
    clusters = sizes.join(label, "cluster").join(words, "cluster").select(
        "cluster", F.substring("t.title", 1, 40).alias("label"), "size", "keywords")
    return clusters, titles.select("cluster", "id", "article_id")
