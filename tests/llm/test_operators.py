"""Each operator on a table of hard cases, against a brute-force version.

The table has null ids, texts and sources, empty and very long texts, repeated rows and ids, ties,
and columns whose names clash with those that the operators use inside.
"""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from pagemill.llm import op01_token_files as op1
from pagemill.llm import op02_source_mix as op2
from pagemill.llm import op03_substring_dedup as op3
from pagemill.llm import op04_jaccard_join as op4
from pagemill.llm import op05_url_filter as op5
from pagemill.llm import op06_quality_rules as op6
from pagemill.llm import op07_byte_bpe as op7
from pagemill.llm import op08_exact_dedup as op8
from pagemill.llm import op09_token_counts as op9
from pagemill.llm import op10_license_scan as op10

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, size string, tok string, norm string"


def hard_rows():
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = prose(60), prose(300).split()
    near = lambda k: " ".join(w if i % 97 != k else "changed" for i, w in enumerate(base))
    texts = [
        None, "", " \t\n", "a", "Two words", prose(19), prose(20), "word " * 50, "A b c\x1cd \x85 e\x0bf  g", "déjà vu — ÀÉÎ ŒUVRE Ünïcode 漢字かな \U0001f600 é 'tis we'll I'd",
        "<|endoftext|> x <|startoftext|>y <|ENDOFTEXT|>", passage + " " + prose(30), prose(10) + " " + passage + " " + prose(5), prose(4) + "\n" + passage, " ".join(base), near(1), near(2), near(3), near(4).upper(), prose(40000),
        "SHOUT!! " * 3 + prose(30).upper(), "\n".join(["the same line"] * 9 + [prose(12)]), prose(25) + " ### $$$ %%% &&&" * 4, "Licensed under the Apache License, Version 2.0.", "x\nReleased under the MIT License.\n" + prose(15), "123 456.7, 8\r\n  9 x.", "tab\tx  y", "a b", "ab",
    ]
    texts += [prose(int(n)) for n in rng.integers(1, 200, 30)]
    rows = [(i, t, "en", ["s1", "s10", "s2", None][i % 4], None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, passage, None, None, 1), (None, passage, None, None, 1), (12, "another text with the id of twelve " + prose(30), "en", "s1", 0), (900, texts[14], "de", "hot", 5), (901, texts[14] + " ", "de", "hot", 5)]
    rows += [(1000 + i, texts[14], "en", "hot", 1) for i in range(40)]
    return [(*r, "x", "y", "z", "t", "n") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(found):
    return Counter(tuple(r) for r in found)


def test_all_operators_on_an_empty_table(spark, empty, tmp_path):
    json_path, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    manifest = op1.write_tokens(empty, str(tmp_path / "t"), P.path("word_bpe_49k.json"), end_id=2)
    assert op1.read_tokens(spark, str(tmp_path / "t"), manifest).count() == 0
    for found in (
        op2.mix(empty), op2.mixed(empty), op3.dedup(empty), op4.jaccard_components(empty), op4.one_of_each(empty), op6.judge(empty), op6.good(empty),
        op7.digests(empty, ranks, P.PATTERN), op8.exact_dedup(empty), op8.one_of_each(empty), op9.count_tokens(empty, json_path), op10.scan(empty),
    ):
        assert found.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert op5.url_filter(pages, op5.labelled_outcomes(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


# 1


def test_token_files(spark, docs, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op1, "SHARD_BYTES", 4000)
    path = str(tmp_path / "tokens")
    manifest = op1.write_tokens(docs, path, P.path("word_bpe_49k.json"), end_id=2)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = [tuple(r) for r in op1.read_tokens(spark, path, manifest).collect()]
    assert Counter((r[0], r[2], r[3]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    keys = [r[0] for r in sorted(found, key=lambda r: r[1]) if r[0] is not None]
    assert keys == sorted(keys)


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5], list(range(300)), [0, 1, 1, 7, 1000, 1000, 10**6], sorted(np.random.default_rng(1).integers(0, 10**7, 5000).tolist())])
def test_elias_fano_round_trip_and_space(values):
    ef = op1.EliasFano.of(np.array(values))
    assert ef.all().tolist() == values == [ef.select(i) for i in range(len(values))]
    n, u = len(values), max(values[-1], 1)
    assert ef.nbytes() * 8 <= n * (3 + max(0, np.log2(u / n))) + 32 * (n / op1.SAMPLE + 1) + 128


def test_shard_reader():
    ids = [b"", b"\1\0\2\0", b"\3\0"]
    s = op1.Shard(op1.pack([5, None, -1], ids, 2))
    assert s.keys == [5, None, -1] and [s.ids(i).tolist() for i in range(3)] == [[], [1, 2], [3]]
    with pytest.raises(ValueError):
        op1.Shard(b"x" * 200)


def test_shard_reader_over_signed_buffers():
    """Arrow's buffers give signed bytes."""
    rng = np.random.default_rng(8)
    ids = [rng.bytes(2 * int(n)) for n in rng.integers(0, 40, 3000)]
    s = op1.Shard(memoryview(op1.pack(list(range(3000)), ids, 2)).cast("b"))
    assert [s.ids(i).tobytes() for i in range(3000)] == ids and s.document(2999)[0] == sum(map(len, ids[:-1])) // 2


# 2


def fixpoint(sizes, weights=op2.WEIGHTS, share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over
    return target


def test_source_mix(docs, rows):
    found = op2.mix(docs).collect()
    size = Counter(r[3] for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = fixpoint(size)
    assert len(found) == len(rows)
    taken = defaultdict(int)
    source_of = defaultdict(set)
    for r in rows:
        source_of[r[0]].add(r[3])
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        source = next(s for s in source_of[r.doc_id] if size[s] == r.source_size)
        assert r.target == pytest.approx(want[source])
        taken[source] += r.taken
    for s, t in want.items():
        assert t - max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) * 4 <= taken[s] <= t + 1e-6
    assert counted(found) == counted(op2.mix(docs).collect())


def test_mixed_rows_follow_the_mix(docs):
    words = lambda t: len(WORD.findall(t or ""))
    assert sum(words(r.text) for r in op2.mixed(docs).collect()) == sum(r.taken for r in op2.mix(docs).collect())


def test_larger_budgets_take_all_that_smaller_ones_take(docs):
    few, many = (Counter(r.doc_id for r in op2.mixed(docs, share=s).collect()) for s in (0.5, 1.0))
    assert all(many[k] >= n for k, n in few.items())


# 3


def brute_removed(rows, window=20):
    """By id (null last), then place; rows with equal ids are apart."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        w = WORD.findall(rows[i][1] or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone[s : s + window] = [True] * window
            seen.add(x)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((rows[i][0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substring_dedup(docs, rows):
    want, found = Counter(brute_removed(rows)), counted(op3.dedup(docs).collect())
    once = {k for k, n in Counter(r[0] for r in rows).items() if n == 1}
    assert {r: n for r, n in want.items() if r[0] in once} == {r: n for r, n in found.items() if r[0] in once}
    assert sum(r[2] * n for r, n in found.items()) == sum(r[2] * n for r, n in want.items())


def test_substring_dedup_with_hot_anchors(docs):
    assert counted(op3.dedup(docs, hot=2).collect()) == counted(op3.dedup(docs).collect())


def test_suffix_automaton_statistics():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [rng.integers(0, 3, rng.integers(0, 25)).tolist() for _ in range(3)]
        a = op3.SuffixAutomaton()
        for t in texts:
            a.add(t)
        q = rng.integers(0, 3, 30).tolist()
        subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((k for k in range(1, i + 2) if tuple(q[i + 1 - k : i + 1]) in subs), default=0) for i in range(len(q))]
        assert a.statistics(q) == want


def test_reference_spans_go(docs, rows):
    reference = [rows[13][1]]
    passage = rows[13][1].split("\n")[1]
    found = {r.doc_id: r for r in op3.remove_reference(docs, reference, least=50).collect()}
    assert passage not in found[11].kept and found[11].n_removed == 60 and found[14].n_removed == 0
    with pytest.raises(ValueError):
        op3.remove_reference(docs, reference, most_words=10)


# 4


def brute_components(rows, roots=False):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    if roots:
        return [find(i) for i in range(len(rows))]
    return [(r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows)]


def test_jaccard_components(docs, rows):
    assert counted(op4.jaccard_components(docs).drop("row", "kept").collect()) == Counter(brute_components(rows))


def test_one_of_each_component(docs, rows):
    found, want = op4.one_of_each(docs), brute_components(rows)
    groups = {(c, n) for _, n, c in want if n and c is not None}
    assert found.columns == docs.columns
    ids = [r.doc_id for r in found.collect()]
    assert {c for c, _ in groups} <= set(ids)
    assert found.count() == len(set(brute_components(rows, roots=True)))


def test_many_near_copies_in_small_groups(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    for name, value in (("GROUP", 7), ("SALT_NODES", 9), ("SALT_QUERIES", 3), ("CELLS", 256)):
        monkeypatch.setattr(op4, name, value)
    found = op4.jaccard_components(spark.read.parquet(str(tmp_path / "d"))).drop("row", "kept")
    assert counted(found.collect()) == Counter(brute_components(rows))


# 5


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/en/1x?y", "https://a.example.org/es/", "https://notexample.org/es/", "http://x.com/fr/a#b", "http://com/de/", "http://x.net", "http://bad.net/en/7", "http://org?x", "https://a.org/en/://b"]
    more = ["http://bad.net/en/7"] * 30 + [f"http://fine{i % 10}.net/en/{100 + i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *more])], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 1), (None, 1, 1), (8, None, None), *[(100 + i, 1, 0) for i in range(60)]], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in op5.url_filter(pages, op5.labelled_outcomes(pages, labels)).collect()}
    assert [found[i].host for i in range(12)] == ["", "", "", "example.org", "a.example.org", "notexample.org", "x.com", "com", "x.net", "bad.net", "org", "a.org"]
    assert [found[i].rule for i in range(12)] == [None, None, None, "example.org/en/1", "example.org/es/", "org/", "com/fr/", "com/de/", None, None, None, "org/"]
    assert found[3].path == "/en/1x" and found[10].path == "" and found[11].path == "/en/://b"
    assert [found[i].verdict for i in (3, 4, 5, 6, 7, 9, 11)] == ["block", "block", "allow", "allow", "block", "block", "allow"]
    assert len(found) == 102 and found[8].verdict == "allow" and found[101].verdict == "allow"


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "w.shop.net:8080": ("shop.net", "net"), "u.github.io": ("u.github.io", "github.io"), "[::1]:9": ("[::1]", "[::1]")}
    k = op5.key_of(F.col("host"))
    found = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", op5.domain_of(k), op5.suffix_of(k)).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == hosts


# 6


def test_quality_measures(docs, rows):
    found = Counter(tuple(r[:7]) for r in op6.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[r[0], len(w), sum(map(len, w)), sum(x in op6.SYMBOLS for x in t), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    assert found == want


def test_quality_verdicts(docs, rows):
    import regex

    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        chars, upper, letters = sum(map(len, w)), len(regex.findall(r"\p{Lu}", t)), len(regex.findall(r"\p{L}", t))
        bad = len(w) < 20 or 100 * len(again) > 30 * len(w) or sum(x in op6.SYMBOLS for x in t) * 10 > len(w) or (len(lines) - len(set(lines))) * 10 > len(lines) * 4
        bad |= sum(a == b for a, b in zip(w, w[1:], strict=False)) * 2 > len(w) or chars < 2 * len(w) or chars > 20 * len(w) or upper * 10 > letters * 6
        want[r[0], not bad] += 1
    assert counted(op6.judge(docs).select("doc_id", "kept").collect()) == want
    assert Counter(r.doc_id for r in op6.good(docs).collect()) == Counter({k: n for (k, kept), n in want.items() if kept})


def test_cascade_order_changes_no_verdict(spark, docs, monkeypatch):
    want = counted(op6.judge(docs).select("doc_id", "kept").collect())
    monkeypatch.setattr(op6, "order", lambda df, found, n=0: sorted(found, reverse=True))
    assert counted(op6.judge(docs).select("doc_id", "kept").collect()) == want
    assert op6.good(docs).columns == docs.columns
    assert op6.good(docs).count() == sum(n for (_, kept), n in want.items() if kept)


def test_rules_are_ordered_by_rejections_per_second(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000)
    assert op6.order(df, {"never": F.lit(False), "often": F.col("id") % 2 == 0}, 1000) == ["often", "never"]


# 7


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [1 << 30, 2000])
def test_byte_bpe(docs, rows, monkeypatch, block):
    monkeypatch.setattr(op7, "BLOCK_BYTES", block)
    monkeypatch.setattr(op7, "RUN_BYTES", max(1000, block // 3))
    enc, want = encoding(), Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert counted(op7.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()) == want


def test_byte_bpe_ids_and_decoding(docs, rows):
    enc, path = encoding(), P.path("byte_bpe_50k.tiktoken")
    found = op7.tokens(docs, path, P.PATTERN)
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1] or ""))) for r in rows)
    got = found.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in op7.decode(found.select("doc_id", "ids"), path).collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)


# 8


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    norm = [re.sub("[\x20\x09-\x0d]", "", r[1] or "") for r in rows]
    for i, r in enumerate(rows):
        groups[norm[i]].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    want = Counter()
    for i, r in enumerate(rows):
        best = min(groups[norm[i]])
        want[r[0], None if best[1] else best[2], len(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()] += 1
    found = op8.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({hashlib.sha256(n.encode()).hexdigest(): 1 for n in groups})
    assert op8.one_of_each(docs).count() == len(groups)


def test_exact_dedup_excludes_collisions(docs):
    """With a hash of 4 bits nearly all groups are collisions."""
    same = lambda d: counted(d.select("keep_id", "group_size", "text_sha256").collect())
    assert same(op8.exact_dedup(docs, hash_hex=1)) == same(op8.exact_dedup(docs))
    assert op8.exact_dedup(docs, hash_hex=1).where("kept").count() == op8.exact_dedup(docs).where("kept").count()


# 9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, rows, name):
    path = P.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        n = lambda x, p=sentencepiece.SentencePieceProcessor(model_file=path): len(p.encode(x))
    want = Counter((r[0], len((r[1] or "").encode()), n(r[1] or ""), n(r[1] or "") > 512) for r in rows)
    assert counted(op9.count_tokens(docs, path).collect()) == want


# 10


def test_license_scan(spark, docs, rows):
    def shingles(t):
        w = WORD.findall(t.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = Counter()
    for r in rows:
        have = set(shingles(r[1] or ""))
        for name, text in op10.TEMPLATES:
            s = set(shingles(text))
            if len(s & have) / len(s) >= 0.8:
                want[r[0], name] += 1
    assert Counter((r.doc_id, r.template) for r in op10.scan(docs).collect()) == want


def test_license_scan_recall_and_partial_matches(spark):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(3000)]
    templates = [(f"L{k}", " ".join(words[k * 40 : k * 40 + n])) for k, n in enumerate((5, 6, 8, 12, 20, 40))]
    rows = []
    for i in range(120):
        k = i % 6
        t = templates[k][1].split()
        pad = lambda: [f"p{x}" for x in rng.integers(0, 9999, rng.integers(0, 60))]
        rows.append((i, " ".join([*pad(), *t, *pad()])))
    rows.append((500, " ".join(templates[5][1].split()[:36] + ["cut"])))
    rows.append((501, " ".join(templates[5][1].split()[:20])))
    found = {(r.doc_id, r.template): r.containment for r in op10.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert sum(found.get((i, f"L{i % 6}")) == 1.0 for i in range(120)) >= 117
    assert 0.8 <= found[500, "L5"] < 1 and (501, "L5") not in found
