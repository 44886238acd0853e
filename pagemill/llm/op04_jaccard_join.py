"""N-gram Jaccard self-join with a token-group matrix, and its components.

A document's set is its distinct N-word shingles, as 64-bit hashes. Documents with equal sets are one
node. Nodes link when DEN * intersection >= NUM * union (100 and 90: a similarity of 0.9).

1. A count sketch of fixed size says which shingles are frequent. It only orders tokens: rarer
   classes first, then by hash. Linked sets share k of the first n - ceil(0.9 n) + k tokens of each
   in any fixed order (prefix filter), for any k up to 0.9 n. The order changes the work and not the result.
2. Nodes that share fewer than k prefix tokens with others are alone; here k is COMMON, n / STEP for large sets and 0.9 n for small ones. Texts are read again for the rest, and their sets written with a sketch of SKETCH_LONGS * 64 bits each.
3. Groups: nodes with the same smallest token, in order of size, GROUP at a time. A group's
   pairs are counted at once, as the product of the matrix of its members and shared tokens with itself.
4. Token-group matrix: for each of the first tokens (k is 1, n / STEP for large sets) the groups that have it, with the union of their
   members' sketches and the members' sizes. Components are dealt into groups of up to GROUP nodes. A node asks for the groups
   of larger components. A query of n tokens of which more than n - 0.9 n surely aren't in a group's union, or with no
   member between 0.9 n and n / 0.9 tokens, does not open the group; this is a condition of the join, so such pairs aren't
   made. Nor does one that shares fewer than k of its first tokens with the group. For groups that open, the union of the sets themselves bounds the overlap again, then members are compared. At first
   nodes ask, for each token, the group of its largest component only, which joins most of what belongs together; components
   are merged and dealt into groups again; then all groups are asked.

Equal texts never meet in pairs, hot smallest tokens are salted (groups may part similar nodes;
step 4 joins them), hot groups are copied over their queries' shares, tokens are counted with partial sums and
joined by plain equality, so adaptive execution splits hot ones, and no row is dropped.

Null ids are kept; a component without other ids has a null id. Null texts and texts without words
have empty sets, which link with nothing. Repeated rows are equal texts. An empty table gives no rows. Columns other than id and
text are not looked at, whatever their names. docs is read more than once
and must give equal rows in equal order, as files do; else an error is raised.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.chunks import release, runs
from pagemill.llm.components import components
from pagemill.llm.op07_byte_bpe import squeeze, unsqueeze
from pagemill.llm.shared import CHANGED, discard, mark, parts, picked, table, written
from pagemill.llm.wordhash import U, grams, hashed_words, mixed

RUN_BYTES = 4 << 20
SKETCH_BITS = 21
#: Longs of a set's sketch, and the columns that hold them.
SKETCH_LONGS = 8
BITS = [f"bits{k}" for k in range(SKETCH_LONGS)]
#: Tokens that prefixes of linked sets have in common at least, or else all that small sets must share.
COMMON = 24
#: Large sets have one in STEP of their tokens more in their prefixes, and must share as many.
STEP = 64
CHUNKS = 32
GROUP = 256
#: Tokens of all members after which a group is full, and cells of a matrix held at once.
GROUP_TOKENS, CELLS = 500_000, 1 << 21
#: Nodes of one smallest token, and queries of one group, that a task takes at once.
SALT_NODES, SALT_QUERIES = 512, 512
#: Up to so many rows of at most some 100 bytes are broadcast, so that texts and sets are not shuffled to meet them.
BROADCAST_ROWS = 200_000


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = hashed_words(texts, lower=True)
    full = grams(h, size)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(full[a : z - size + 1]))
        elif z > a:  # the whole sequence
            out.append(mixed(grams(h[a:z], z - a) ^ mixed(np.full(1, z - a, U))))
        else:
            out.append(np.zeros(0, U))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_LONGS integers with a bit set for each token."""
    bits = np.zeros(SKETCH_LONGS * 64, bool)
    bits[(s & U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * inter >= num * (len(both) - inter)


def owners(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(member, column) of the tokens that two sets or more have, columns being distinct tokens, and how many there are."""
    tokens = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    _, column = np.unique(column[often], return_inverse=True)
    return member[often], column, int(column.max()) + 1 if len(column) else 0


def group_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which members link, as a square of booleans."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    member, column, width = owners(sets)
    inter, step = np.zeros((m, m), np.float32), max(1, CELLS // m)
    edges = np.searchsorted(column, np.arange(0, width + step, step))
    for k in range(len(edges) - 1):
        cut = slice(edges[k], edges[k + 1])
        block = np.zeros((m, step), np.float32)
        block[member[cut], column[cut] - k * step] = 1
        inter += block @ block.T
    inter = inter.astype(np.int64)
    np.fill_diagonal(inter, sizes)
    return den * inter >= num * (sizes[:, None] + sizes[None, :] - inter)


def group_roots(links: np.ndarray) -> np.ndarray:
    """For each member the best-linked one of its component (of equal ones the first)."""
    m = len(links)
    label = np.arange(m)
    while True:
        new = np.where(links, label[None, :], m).min(axis=1)
        new = np.minimum(label, new)[new]
        if np.array_equal(new, label):
            break
        label = new
    degree = links.sum(axis=1)
    best = np.zeros(m, np.int64)
    for k in np.unique(label).tolist():
        own = np.flatnonzero(label == k)
        best[own] = own[np.argmax(degree[own])]
    return best


def prefix(s: np.ndarray, classes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens of which every other set that links with s has shared_at_least() in its own prefix, in order; none if only equal sets link."""
    n = len(s)
    if n * (den - num) < num:
        return s[:0]
    least = -(-num * n // den)
    key = classes[s & U(len(classes) - 1)].astype(U) << U(58) | s >> U(6)
    return s[np.argsort(key, kind="stable")[: n - least + min(max(COMMON, n // STEP), least)]]


def least_overlap(n, num: int, den: int):
    """Column: the tokens that a set of n shares at least with any that links with it."""
    return F.ceil(n * num / den)


def first_tokens(n):
    """Column: how many tokens linked sets share among their first ones; it grows with n."""
    return F.greatest(F.lit(1), F.floor(n / STEP))


def shared_at_least(n, num: int, den: int):
    """Column: the prefix tokens that a set of n shares at least with any that links with it, the smallest having 0.9 n."""
    smallest = least_overlap(n, num, den)
    return F.least(F.greatest(F.lit(COMMON), F.floor(smallest / STEP)), least_overlap(smallest, num, den))


def _frequencies(d: DataFrame, size: int) -> np.ndarray:
    """The class (bit length) of each counter of the sketch: a fixed number of bytes, whatever the corpus."""

    def count(batches):
        sums = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for b in runs(whole, 0, RUN_BYTES):
                tokens = np.concatenate([np.zeros(0, U), *shingle_sets(b.column(0), size)])
                sums += np.bincount((tokens & U(len(sums) - 1)).astype(np.int64), minlength=len(sums))
        for k, part in enumerate(np.split(sums, CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([squeeze(part)])], names=["chunk", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = unsqueeze(x)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([squeeze(x)])], names=["chunk", "data"])

    kind = "chunk long, data binary"
    rows = d.select("text").mapInArrow(count, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect()
    sums = np.concatenate([unsqueeze(r.data) for r in sorted(rows, key=lambda r: r.chunk)]) if rows else np.zeros(1 << SKETCH_BITS, np.int64)
    return np.ceil(np.log2(sums + 1)).astype(np.uint8)


def small(rows: DataFrame) -> DataFrame:
    """rows (written, without texts or sets), broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def linked_rows(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(doc_id, n_shingles, component_id, row, mark, kept: a row for each row of docs; how many there are).

    row: monotonically_increasing_id() of the row in docs. mark: a hash of its id and text. kept: true for one row of each component, that
    of the smallest id (null ids last), then the first; true for rows with empty sets.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumns({"row": F.monotonically_increasing_id(), "mark": mark(F.col("doc_id"), F.col("text"))})
    n = parts(d)
    classes = spark.sparkContext.broadcast(_frequencies(d, size))

    def describe(batches):
        for whole in batches:
            for b in runs(whole, 1, RUN_BYTES):
                sets = shingle_sets(b.column(1), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([int(s[0].astype(np.int64)) if len(s) else None for s in sets], pa.int64()),
                        pa.array([prefix(s, classes.value, num, den).view(np.int64) for s in sets], pa.list_(pa.int64())), b.column(3),
                    ],
                    names=["doc_id", "row", "n", "sig", "least", "prefix", "mark"],
                )

    all_docs = written(d.mapInArrow(describe, "doc_id long, row long, n long, sig binary, least long, prefix array<long>, mark long"), "shingle-sets")
    one = F.min(F.struct("row", "n", "least", "prefix")).alias("x")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    nodes = all_docs.where("n > 0").groupBy("sig").agg(one, best)
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "sig", "best", "x.row", "x.n", "x.least", "x.prefix"), "shingle-nodes")

    early = F.col("pos") < F.col("n") - least_overlap(F.col("n"), num, den) + first_tokens(F.col("n"))
    tokens = nodes.where("size(prefix) > 0").select("node", "n", F.posexplode("prefix").alias("pos", "tok")).select("tok", "node", early.alias("early"))
    often = tokens.groupBy("tok").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("tok")
    in_two = written(tokens.join(often, "tok").select("tok", "node", "early"), "tokens-of-two")
    counts = in_two.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(nodes.select("node", "row", "sig", "least", "n"), "node")
    some = written(counts.where(F.col("c") >= shared_at_least(F.col("n"), num, den)).select("node", "row", "sig", "least"), "nodes-that-share")
    shared = written(in_two.where("early").join(small(some.select("node")), "node").select("tok", "node"), "shared-tokens")
    discard(in_two)
    shares = some.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / SALT_NODES).alias("shares"))
    some = written(some.join(shares, "least").withColumn("salt", F.pmod(F.xxhash64("node"), "shares")).drop("shares"), "nodes-to-compare")

    def again(batches):
        for whole in batches:
            for b in runs(whole, 0, RUN_BYTES):
                sets = shingle_sets(b.column(0), size)
                for s, sig in zip(sets, b.column(4).to_pylist(), strict=True):
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != sig:
                        raise RuntimeError(CHANGED)
                bits = np.stack([sketch(s) for s in sets], axis=1) if sets else np.zeros((SKETCH_LONGS, 0), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), b.column(2), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, bits)],
                    names=["node", "least", "salt", "n", "tokens", *BITS],
                )

    texts = d.join(small(some), "row").select("text", "node", "least", "salt", "sig")
    sets = written(texts.mapInArrow(again, f"node long, least long, salt long, n long, tokens binary, {', '.join(f'{k} long' for k in BITS)}"), "sets-to-compare")

    def group(batches):
        """Sorted by smallest token, share and size: node, root (in the group's components), grp (the first node of the group)."""
        last, nodes_, held, size = None, [], [], 0

        def done():
            root = group_roots(group_links(held, num, den))
            ids = np.array(nodes_, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(np.full(len(ids), ids[0]))], names=["node", "root", "grp"])

        for b in batches:
            for node, least, salt, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if held and ((least, salt) != last or len(held) == GROUP or size >= GROUP_TOKENS):
                    yield done()
                    nodes_, held, size = [], [], 0
                last = least, salt
                nodes_.append(node)
                held.append(np.frombuffer(data, U))
                size += len(held[-1])
        if held:
            yield done()
        release()

    meet = sets.select("node", "least", "salt", "n", "tokens").repartition(n, "least", "salt").sortWithinPartitions("least", "salt", "n", "node")
    groups = written(meet.mapInArrow(group, "node long, root long, grp long"), "similar-groups")

    def open_groups(batches):
        """Sorted by group, share and kind: the members, then queries. For each query a link with each component of the group."""
        last, members, union, matrix = None, [], None, None
        for b in batches:
            out = []
            for grp, share, kind, node, comp, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (grp, share) != last:
                    last, members, union, matrix = (grp, share), [], None, None
                s = np.frombuffer(data, U)
                if kind == 0:
                    members.append((node, comp, s))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([np.zeros(0, U), *(t for _, _, t in members)]))
                    sizes = np.array([len(t) for _, _, t in members])
                    if members and len(union) * len(members) <= 8 * CELLS:
                        matrix = np.zeros((len(union), len(members)), np.uint8)
                        for i, (_, _, t) in enumerate(members):
                            matrix[np.searchsorted(union, t), i] = 1
                if not len(union):
                    continue
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                at = at[union[at] == s]
                if den * len(at) < num * len(s):
                    continue
                if matrix is not None:
                    inter = matrix[at].sum(axis=0, dtype=np.int64)
                    hits = np.flatnonzero(den * inter >= num * (sizes + len(s) - inter)).tolist()
                else:
                    hits = [i for i, (_, _, t) in enumerate(members) if linked(s, t, num, den)]
                out += [(node, k) for k in {members[i][1] for i in hits}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        release()

    def cross(labels: DataFrame, largest_only: bool) -> DataFrame:
        """Links between nodes of different groups and components. labels: node, component."""
        of = groups.join(labels, "node").withColumnRenamed("component", "comp")
        of = of.join(of.groupBy("comp").agg(F.count(F.lit(1)).alias("weight")), "comp")
        slot = F.pmod(F.xxhash64("node"), F.ceil(F.col("weight") / GROUP))
        of = of.select("node", "comp", F.struct("weight", "comp").alias("rank"), F.xxhash64("comp", slot).alias("grp"))
        of = written(of.join(sets.select("node", "n", *BITS), "node"), "components-in-groups")
        tok = shared.join(small(of if not largest_only else of.drop(*BITS)), "node").drop("comp")
        could = (F.col("grp") != F.col("own")) & (F.col("rank") < F.col("top"))
        could = could & (F.col("n") * den >= F.col("low") * num) & (F.col("high") * den >= F.col("n") * num)
        bounds = [F.max("rank").alias("top"), F.min("n").alias("low"), F.max("n").alias("high")]
        if largest_only:
            fields = ["top", "grp", "low", "high"]
            matrix = tok.groupBy("tok", "grp").agg(*bounds).groupBy("tok").agg(F.max(F.struct(*fields)).alias("m")).select("tok", *[f"m.{k}" for k in fields])
        else:
            matrix = tok.groupBy("tok", "grp").agg(*bounds, *[F.bit_or(k).alias(f"any_{k}") for k in BITS])
            absent = reduce(add, [F.bit_count(F.col(k).bitwiseAND(F.bitwise_not(f"any_{k}"))) for k in BITS])
            could = could & (absent <= F.col("n") - least_overlap(F.col("n"), num, den))
        asked = tok.withColumnRenamed("grp", "own").join(matrix, "tok").where(could)
        enough = F.col("c") >= first_tokens(least_overlap(F.col("n"), num, den))
        pairs = written(asked.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where(enough).select("node", "grp"), "queries")
        if not pairs.head(1):
            return pairs.select(F.col("node").alias("a"), F.col("node").alias("b"))
        split = written(pairs.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SALT_QUERIES).alias("shares")), "query-shares")
        queries = pairs.join(split, "grp").withColumns({"share": F.pmod(F.xxhash64("node"), "shares"), "kind": F.lit(1), "comp": F.col("node")})
        opened = of.join(split, "grp").withColumns({"share": F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)), "kind": F.lit(0)})
        cols = ["grp", "share", "kind", "node", "comp"]
        asked_rows = written(opened.select(cols).unionByName(queries.select(cols)), "asked")
        both = sets.select("node", "tokens").join(small(asked_rows), "node").select(*cols, "tokens")
        ordered = both.repartition(n, "grp", "share").sortWithinPartitions("grp", "share", "kind", "node")
        links = written(ordered.mapInArrow(open_groups, "a long, b long"), "links")
        discard(pairs, asked_rows)
        return links

    edges = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    labels = groups.select("node", F.col("root").alias("component"))
    for largest_only in (True, False):
        links = cross(labels, largest_only)
        if links.head(1):
            edges = edges.unionByName(links)
            found = components(edges).withColumnRenamed("component", "c")
            labels = written(groups.select("node").join(found, "node", "left").select("node", F.coalesce("c", "node").alias("component")), "components")

    joined = nodes.select("node", "sig", "best").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = joined.groupBy("component").agg(F.min("best").alias("first"))
    of_sig = written(joined.join(first, "component").select("sig", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")), "component-ids")
    discard(shared, sets, nodes)
    full = F.col("n") > 0
    rows = all_docs.select("doc_id", "row", "mark", "n", F.when(full, F.col("sig")).alias("sig")).join(of_sig, "sig", "left")
    component = F.when(full, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row", "mark", (~full | (F.col("row") == F.col("first_row"))).alias("kept"))
    return rows, all_docs.count()


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """linked_rows() without marks: doc_id, n_shingles, component_id, row, kept."""
    return linked_rows(docs, **options)[0].drop("mark")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    found, rows = linked_rows(docs, id_col=id_col, text_col=text_col, **options)
    return picked(docs, written(found.where("kept").select("row", "mark"), "components-kept"), rows, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("row", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
part(id, component) USING KEY (id) AS (SELECT doc_id, doc_id FROM t
  UNION SELECT edge.b, min(part.component) FROM part JOIN edge ON edge.a = part.id JOIN recurring.part AS old ON old.id = edge.b WHERE part.component < old.component GROUP BY edge.b)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component AS component_id FROM t JOIN part ON part.id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""
