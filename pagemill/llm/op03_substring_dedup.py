"""Substring dedup by suffix automata of reference shards.

SuffixAutomaton gives the matching statistics of a stream of words: for each position, the
length of the longest match that ends there and occurs in the reference. remove_reference()
broadcasts the automata of a reference of bounded size (checked) and streams documents past them.

dedup() removes what a corpus repeats of itself. Its reference is the corpus, which no broadcast
can hold, so the reference shards are dealt by content and documents are sent to the shards that
can match them:

1. Every window of WINDOW words has an anchor, the ANCHOR consecutive words in it with the
   smallest hash (the leftmost of equal ones); equal windows have equal anchors. Consecutive
   windows with the same anchor are a unit, some 25 words. Anchors are counted over the corpus: each
   block of documents sends a row for each of its distinct anchors, and those that come again are named to their blocks.
2. Units whose anchor is unique are done. The others are sent to the shard of their anchor, a row each. Of
   equal units a block sends the first and marks the rest; units of anchors with more than HOT
   occurrences are sent as single windows by the windows' own hashes, so no group holds more
   than one row a block of any content, whatever share of the corpus a passage has.
3. In a shard, the units of an anchor stream in order past the automaton of all earlier units of
   that anchor: positions with a match of WINDOW words or more end a window that starts earlier.
   Units with other windows left join the automaton, so it holds each reference text once.
4. Windows found go back to their blocks, where the covered words are removed.

The work for a block depends on its own size only, not on the number of blocks or partitions.

"Earlier" is by document id (null ids last), then by place in the input, then by position. Null
texts have no words. Rows with the same id are documents of their own, the first in the input
counting as earlier. The input is read once for step 1 and again for step 2 and must give the
same rows in the same order, as files do; a difference raises an error. Words are compared by
64-bit hashes. An empty table gives no rows, columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.op07_byte_bpe import batch, squeeze, unsqueeze
from pagemill.llm.shared import CHANGED, parts, table, written
from pagemill.llm.chunks import release, runs
from pagemill.llm.wordhash import grams, hashed_words

WINDOW = 20
ANCHOR = 7
HOT = 2000
BLOCK_BYTES = 10 << 20
DOCS_BYTES = 2 << 20
NULL_ID = (1 << 63) - 1


class SuffixAutomaton:
    """Of several sequences; transitions in one dict a state."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length, link, follow):
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p, c, q):
        """The state for the matches of p followed by c, which q mixes with longer ones."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def statistics(self, sequence) -> list[int]:
        """For each position the length of the longest match that ends there."""
        found, state, n = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (q := self.next[state].get(c)) is not None:
                state, n = q, n + 1
            found.append(n)
        return found


def spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans [start, end) covered by matches of `least` or more."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= least:
            a = i + 1 - n
            if out and a <= out[-1][1]:
                out[-1] = (min(out[-1][0], a), i + 1)
            else:
                out.append((a, i + 1))
    return out


def remove_reference(docs: DataFrame, reference: list[str], least: int = WINDOW, shard_words: int = 200_000, most_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: documents without the spans of `least` or more words that occur in the reference.

    The reference is broadcast as automata of shards of about shard_words words; one of more than
    most_words raises an error (use dedup() on the union instead). Null texts have no words.
    """
    shards, size = [[]], 0
    for text in reference:
        w = (text or "").encode().split()
        size += len(w)
        if shards[-1] and sum(map(len, shards[-1])) + len(w) > shard_words:
            shards.append([])
        shards[-1].append(w)
    if size > most_words:
        raise ValueError(f"the reference has {size} words, more than {most_words}")
    built = []
    for shard in shards:
        automaton = SuffixAutomaton()
        for w in shard:
            automaton.add(w)
        built.append(automaton)
    shared = docs.sparkSession.sparkContext.broadcast(built)

    def stream(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = (t or "").encode().split()
                cover = bytearray(len(w))
                for automaton in shared.value:
                    for a, z in spans(automaton.statistics(w), least):
                        cover[a:z] = b"\1" * (z - a)
                rows.append((k, len(w), sum(cover), b" ".join(x for x, c in zip(w, cover, strict=True) if not c).decode()))
            yield batch(rows, ("doc_id", "n_words", "n_removed", "kept"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(stream, "doc_id long, n_words long, n_removed long, kept string")


def units(h: np.ndarray, at: np.ndarray, window: int, anchor: int):
    """(anchor hash, document, first window, number of windows) of the units of all documents, as arrays."""
    g = grams(h, anchor)
    span = window - anchor + 1
    out = [], [], [], []
    for d in range(len(at) - 1):
        a, z = int(at[d]), int(at[d + 1])
        if z - a < window:
            continue
        own = g[a : z - anchor + 1]
        low = np.lib.stride_tricks.sliding_window_view(own, span).argmin(axis=1)
        low += np.arange(len(low))
        first = np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1])
        out[0].append(own[low[first]])
        out[1].append(np.full(len(first), d, np.int64))
        out[2].append(first)
        out[3].append(np.diff(np.append(first, len(low))))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64 if i == 0 else np.int64) for i, x in enumerate(out)]


def _blocks(batches):
    """(number, ids, texts) of the blocks of a partition."""
    number, held, size = None, [], 0

    def block():
        ids = [k for b in held for k in b.column(0).to_pylist()]
        return number, np.array([NULL_ID if k is None else k for k in ids], np.int64), pa.concat_arrays([b.column(1) for b in held]).fill_null("")

    for whole in batches:
        for b in runs(whole, 1, BLOCK_BYTES // 2):
            if number is None:
                number = b.column(2)[0].as_py() << 32
            held.append(b)
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()


#: Rows that go to a block: 0 for a repeated anchor (key, n: 1, or 2 for a hot one; -1 with a checksum of all), 1 for texts.
TO_BLOCK = "block long, kind int, key long, n int, data binary"
#: Rows that leave a block: 0 for a unit (key, the rest of it, words as hashes), 1 for documents with repeated anchors, 2 for results of those without.
FROM_BLOCK = "block long, kind int, key long, id long, doc int, start int, windows int, data binary"


def rows_of(schema: str, count: int, /, **columns) -> pa.RecordBatch:
    """count rows; columns: one value for all, or an array; those that aren't given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrays, names = [], []
    for name, kind in (c.split() for c in schema.split(", ")):
        v, t = columns.get(name), kinds[kind]
        if v is None:
            arrays.append(pa.nulls(count, t))
        elif isinstance(v, np.ndarray):
            arrays.append(pa.array(v.view(np.int64) if v.dtype == np.uint64 else v).cast(t))
        else:
            arrays.append(pa.array(v if isinstance(v, list) else [v] * count, t))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def checksum(anchors: np.ndarray) -> int:
    """Of distinct anchors."""
    return int(np.bitwise_xor.reduce(anchors, initial=np.uint64(len(anchors))).astype(np.int64))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Digest:
    schema = OUT
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    @staticmethod
    def rows(rows):
        """rows: (id, words, mask of kept words or None for all)."""
        out = []
        for k, w, mask in rows:
            kept = w if mask is None else [w[i] for i in np.flatnonzero(mask).tolist()]
            out.append((None if k == NULL_ID else k, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return batch(out, ("doc_id", "n_words", "n_removed", "kept_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))


class Text:
    schema = "doc_id long, n_words long, n_removed long, kept string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @staticmethod
    def rows(rows):
        out = []
        for k, w, mask in rows:
            kept = w if mask is None else [w[i] for i in np.flatnonzero(mask).tolist()]
            out.append((None if k == NULL_ID else k, len(w), len(w) - len(kept), b" ".join(kept).decode()))
        return batch(out, ("doc_id", "n_words", "n_removed", "kept"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))


class UnitMatcher:
    """Takes the units of an anchor (words as 8-byte hashes) in order, and gives for each the runs (first window, number) of
    windows that an earlier one has."""

    def __init__(self, window: int):
        self.window, self.seen, self.first, self.automaton = window, set(), None, None

    def match(self, x: bytes) -> list[tuple[int, int]]:
        n = len(x) // 8
        if x in self.seen:
            return [(0, n - self.window + 1)]
        self.seen.add(x)
        if self.first is None:
            self.first = x
            return []
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
            self.automaton.add(np.frombuffer(self.first, "<u8").tolist())
        sequence = np.frombuffer(x, "<u8").tolist()
        own: list[tuple[int, int]] = []
        for i, m in enumerate(self.automaton.statistics(sequence)):
            if m >= self.window:
                s = i + 1 - self.window
                if own and own[-1][0] + own[-1][1] == s:
                    own[-1] = (own[-1][0], own[-1][1] + 1)
                else:
                    own.append((s, 1))
        if sum(c for _, c in own) < n - self.window + 1:
            self.automaton.add(sequence)
        return own


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, result=Digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs, as `result` gives it (Digest, Text)."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (F.spark_partition_id() + 1).cast("long").alias("part"))
    n = parts(d)

    def anchors_of(batches):
        for number, _, texts in _blocks(batches):
            found, *_ = units(*hashed_words(texts), window, anchor)
            distinct, times = np.unique(found, return_counts=True)
            yield rows_of("anchor long, block long, times long", 1, anchor=checksum(distinct), block=number, times=-1)
            if len(distinct):
                yield rows_of("anchor long, block long, times long", len(distinct), anchor=distinct, block=number, times=times)

    def count_anchors(batches):
        """Sorted by anchor: those that come twice or more, to each of their blocks; checksums as they are."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def counted(anchors, blocks, times):
            first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
            total = np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(anchors))))
            some = total > 1
            if some.any():
                yield rows_of(TO_BLOCK, int(some.sum()), block=blocks[some], kind=0, key=anchors[some], n=(1 + (total[some] > hot)).astype(np.int32))

        for b in batches:
            anchors, blocks, times = (c.to_numpy() for c in b.columns)
            if (sums := times < 0).any():
                yield rows_of(TO_BLOCK, int(sums.sum()), block=blocks[sums], kind=0, key=anchors[sums], n=-1)
                anchors, blocks, times = anchors[~sums], blocks[~sums], times[~sums]
            if not len(anchors):
                continue
            held.append((anchors, blocks, times))
            if held[0][0][0] != anchors[-1]:  # the last anchor may go on in the next batch
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], anchors[-1]))
                yield from counted(*(x[:cut] for x in whole))
                held = [tuple(x[cut:] for x in whole)]
        if held:
            yield from counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def texts_of(batches):
        for number, ids, texts in _blocks(batches):
            start = k = 0
            for run in runs(pa.record_batch([texts], names=["text"]), 0, DOCS_BYTES):
                yield rows_of(TO_BLOCK, 1, block=number, kind=1, key=k, data=squeeze((ids[start : start + run.num_rows], run.column(0).to_pylist())))
                start, k = start + run.num_rows, k + 1

    def route(batches):
        """Sorted by block, kind: the block's repeated anchors, then its texts. Gives FROM_BLOCK; documents with repeated anchors come
        with what the block knows to go."""
        block, named, held = None, [], []

        def done():
            ids = np.concatenate([x for x, _ in held])
            listed = [t for _, x in held for t in x]
            texts = pa.array(listed, pa.string())
            h, at = hashed_words(texts)
            found, doc, first, count = units(h, at, window, anchor)
            if not named:
                raise RuntimeError(CHANGED)
            keys_, values = (np.concatenate(x) for x in zip(*named, strict=True))
            sums, keys_, values = keys_[values < 0], keys_[values > 0], values[values > 0]
            order = np.argsort(keys_)
            keys_, values = keys_[order], values[order]
            if sums.tolist() != [checksum(np.unique(found))]:
                raise RuntimeError(CHANGED)
            kind = np.zeros(len(found), np.int32)
            if len(keys_):
                at_key = np.minimum(np.searchsorted(keys_, found.view(np.int64)), len(keys_) - 1)
                kind = np.where(keys_[at_key] == found.view(np.int64), values[at_key], 0)
            some = np.flatnonzero(kind)
            # (hash, document, first window, windows) of what is compared: units, or windows of hot anchors
            cold = some[kind[some] == 1]
            keys, docs_, starts, counts = [found[cold]], [doc[cold]], [first[cold]], [count[cold]]
            if len(heat := some[kind[some] == 2]):
                w = grams(h, window)
                rep = np.repeat(heat, count[heat])
                s = first[rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(count[heat]) - count[heat], count[heat]))
                keys.append(w[at[doc[rep]] + s])
                docs_.append(doc[rep])
                starts.append(s)
                counts.append(np.ones(len(rep), np.int64))
            keys, docs_, starts, counts = (np.concatenate(x) for x in (keys, docs_, starts, counts))
            order = np.lexsort((starts, docs_, ids[docs_] if len(docs_) else docs_, keys))
            keys, docs_, starts, counts = keys[order], docs_[order], starts[order], counts[order]
            begin = (at[docs_] + starts).tolist()
            end = (at[docs_] + starts + counts + (window - 1)).tolist()
            raw, sent, local, seen, last = h.tobytes(), [], [], set(), None
            contents = []
            for i, k in enumerate(keys.tolist()):
                x = raw[begin[i] * 8 : end[i] * 8]
                if k != last:
                    seen, last = set(), k
                if x in seen:
                    local.append(i)
                else:
                    seen.add(x)
                    sent.append(i)
                    contents.append(x)
            sent = np.array(sent, np.int64)
            if len(sent):
                yield rows_of(FROM_BLOCK, len(sent), block=block, kind=0, key=keys[sent], id=ids[docs_[sent]], doc=docs_[sent], start=starts[sent], windows=counts[sent], data=contents)
            local = np.array(local, np.int64)
            gone = docs_[local], starts[local], counts[local]
            touched = np.zeros(len(ids), bool)
            touched[docs_] = True
            for mark, kind_ in ((touched, 1), (~touched, 2)):
                which, size, run = np.flatnonzero(mark).tolist(), 0, []
                for i in which:
                    run.append(i)
                    size += len(listed[i])
                    if size >= DOCS_BYTES or i == which[-1]:
                        if kind_ == 1:
                            own = np.isin(gone[0], run)
                            data = squeeze((run, ids[run], [listed[j] for j in run], [x[own] for x in gone]))
                        else:  # nothing goes, so the rows are ready
                            data = squeeze(result.rows([(int(ids[j]), listed[j].encode().split(), None) for j in run]).to_pydict())
                        yield rows_of(FROM_BLOCK, 1, block=block, kind=kind_, key=run[0], data=data)
                        run, size = [], 0
            release()

        for b in batches:
            at, of = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])).tolist() if len(at) else []
            for a, z in zip(edge, [*edge[1:], len(at)], strict=True):
                if at[a] != block:
                    if held:
                        yield from done()
                    block, named, held = int(at[a]), [], []
                if of[a] == 0:
                    named.append((b.column(2)[a:z].to_numpy(), b.column(3)[a:z].to_numpy()))
                else:
                    held += [unsqueeze(x) for x in b.column(4)[a:z].to_pylist()]
        if held:
            yield from done()

    def compare(batches):
        """Sorted by key and place: the units of an anchor in order past its automaton; windows that go, to their blocks."""
        key, matcher = None, None
        for b in batches:
            out = []
            for k, block, doc, start, data in zip(*(b.column(i).to_pylist() for i in (2, 0, 4, 5, 7)), strict=True):
                if k != key:
                    key, matcher = k, UnitMatcher(window)
                out += [(block, doc, start + s, c) for s, c in matcher.match(data)]
            if out:
                blocks, docs_, starts, counts = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield rows_of(FROM_BLOCK, len(out), block=blocks, kind=0, key=0, doc=docs_, start=starts, windows=counts)
        release()

    def finish(batches):
        """Sorted by block, kind: windows that go, then documents."""
        block, go = None, []

        def one(run, ids, texts, local):
            more = np.stack([x.astype(np.int64) for x in local], axis=1)
            more = more[np.argsort(more[:, 0], kind="stable")]
            for j, i in enumerate(run):
                w, mask = texts[j].encode().split(), None
                for x in (go, more):
                    a, z = np.searchsorted(x[:, 0], [i, i + 1])
                    if a < z:
                        if mask is None:
                            mask = np.zeros(len(w) + 1, np.int64)
                        np.add.at(mask, x[a:z, 1], 1)
                        np.add.at(mask, x[a:z, 1] + x[a:z, 2] + window - 1, -1)
                yield int(ids[j]), w, None if mask is None else np.cumsum(mask)[:-1] == 0

        for b in batches:
            at, of = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])).tolist() if len(at) else []
            for a, z in zip(edge, [*edge[1:], len(at)], strict=True):
                if at[a] != block:
                    block, go = int(at[a]), []
                if of[a] == 0:
                    go.append(np.stack([b.column(i)[a:z].to_numpy() for i in (4, 5, 6)], axis=1))
                    continue
                if isinstance(go, list):
                    go = np.concatenate([np.zeros((0, 3), np.int64), *go]).astype(np.int64)
                    go = go[np.argsort(go[:, 0], kind="stable")]
                for data in b.column(7)[a:z].to_pylist():
                    yield result.rows(list(one(*unsqueeze(data))))

    def unpack(batches):
        for b in batches:
            for data in b.column(7).to_pylist():
                yield pa.RecordBatch.from_pydict(unsqueeze(data), schema=result.arrow)

    def spread(df, key, *more):
        return df.repartition(n, key).sortWithinPartitions(key, *more)

    anchors = spread(d.mapInArrow(anchors_of, "anchor long, block long, times long"), "anchor")
    to_blocks = anchors.mapInArrow(count_anchors, TO_BLOCK).unionByName(d.mapInArrow(texts_of, TO_BLOCK))
    routed = written(spread(to_blocks, "block", "kind", "key").mapInArrow(route, FROM_BLOCK), "substring-units")
    gone = spread(routed.where("kind = 0"), "key", "id", "block", "doc", "start").mapInArrow(compare, FROM_BLOCK)
    touched = spread(gone.unionByName(routed.where("kind = 1")), "block", "kind", "key").mapInArrow(finish, result.schema)
    return touched.unionByName(routed.where("kind = 2").mapInArrow(unpack, result.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM t, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20),
gone AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
cover AS (SELECT DISTINCT doc_id, i + k AS p FROM gone, range(0, 20) AS r(k)),
word AS (SELECT doc_id, p, w[p] AS x FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS s, count(*) AS n FROM word ANTI JOIN cover USING (doc_id, p) GROUP BY word.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""
