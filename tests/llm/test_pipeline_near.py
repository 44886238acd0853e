"""The near_dedup stage and the pipeline against a brute force with 5-word shingles and a similarity of 0.8."""

import hashlib
from collections import Counter

import corpus_pipeline
from pagemill.llm import op02_source_mix as op2
from pagemill.llm import op06_quality_rules as op6
from test_operators import WORD, encoding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_kept(rows):
    """The least id of each component of (id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def test_near_copies_between_the_two_bounds(spark, tmp_path):
    base = [f"w{i}" for i in range(200)]
    other = list(base)
    for k in (20, 70, 120, 170):
        other[k] = f"x{k}"
    a, b = (shingles(" ".join(w), 3) for w in (base, other))
    assert len(a & b) / len(a | b) < 0.9
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:100])), (4, "One two three four"), (5, "one TWO three four"), (6, "one two three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == brute_kept(rows) == [1, 3, 4, 6]


def test_pipeline_against_brute_force_of_five_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    best = {}
    for k in sorted(r.doc_id for r in op6.judge(docs).where("kept").collect()):
        best.setdefault("".join(c for c in rows[k].text or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(rows[k].text or ""), k))
    exact = sorted(min(v)[1] for v in best.values())
    near = brute_kept([(k, rows[k].text) for k in exact])
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in op2.mix(spark.createDataFrame([rows[k] for k in near], docs.schema)).collect()}
    enc, want = encoding(), Counter()
    for k in near:
        text = rows[k].text or ""
        ids = enc.encode_ordinary(text)
        want[k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += taken[k]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == +want
