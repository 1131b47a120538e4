"""Classifiers by held-out accuracy, page texts by hand-made pages, neighbours by brute force, and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packlake.llm import ann, htmltext, quality, toxicity
from packlake.llm.toxicity import Lexicon

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def measured(spark, scored, label):
    rows = scored.join(table(spark, "labels"), "doc_id").select("doc_id", "score", F.col(label).alias("y")).collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = ([r.score for r in rows if r.y == y] for y in (1, 0))
    return rows, sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality(spark):
    docs = table(spark, "documents")
    model = quality.fit(docs, table(spark, "labels"))
    rows, auc = measured(spark, docs.select("doc_id", quality.score(F.col("text"), model).alias("score")), "quality")
    assert auc > 0.85
    assert np.mean([(r.score >= 0.3) == r.y for r in rows]) > 0.9


def test_toxicity(spark):
    docs = table(spark, "documents")
    model = toxicity.fit(docs, table(spark, "labels"))
    rows, auc = measured(spark, docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score")), "toxic")
    assert auc > 0.8
    assert np.mean([(r.score >= 0.5) == r.y for r in rows]) > 0.9


def test_pieces_cover_a_text(spark):
    def cut(text):
        return spark.createDataFrame([(text,)], "t string").select(quality.spread_pieces(F.col("t"), 3, 10).alias("p")).first().p

    assert cut("") == [""] and cut("é" * 25) == ["é" * 10, "é" * 10, "é" * 5]
    long = "".join(chr(97 + k % 26) for k in range(1000))
    assert cut(long) == [long[:10], long[495:505], long[-10:]]


def plain_score(text, model):
    """The score by a plain loop over the definition of its features."""
    import zstandard

    raw = text.encode()
    if not raw:
        x = np.zeros(7)
    else:
        sizes = []
        for dictionary in (*model["dictionaries"], None):
            extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
            sizes.append(len(zstandard.ZstdCompressor(level=3, **extra).compress(raw)))
        bad, good, plain = sizes
        d, r, n = (bad - good) / max(bad, good), plain / len(raw), np.log(1 + len(raw))
        x = np.array([d, d * abs(d), r, r * r, n, d * n, r * n])
    curve = model["curve"]
    z = sum((x[k] - curve["mean"][k]) / curve["spread"][k] * curve["beta"][k] for k in range(7)) + curve["beta"][7]
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_quality_learns_behind_a_long_beginning(spark, documents):
    """Labels that only the ends of texts bear out; one id is repeated very often."""
    pick = random.Random(8)
    good, bad = ("river stone garden window letter morning candle bridge".split(), "zxq vvk qqj wkz jjx kqv xzw pqk".split())
    same = "".join(pick.choice("abcdefghij ") for _ in range(10_000))
    rows = [(d, same + " ".join(pick.choice(good if d % 2 else bad) for _ in range(1500))) for d in range(200)]
    rows += [(3, rows[0][1][-3000:])] * 300
    labels = spark.createDataFrame([(d, d % 2) for d in range(200)], "doc_id bigint, quality int")
    model = quality.fit(documents(rows), labels, per_class=60)
    asked = documents([(1000, rows[1][1][10_000:]), (1001, rows[0][1][10_000:]), (1002, ""), (1003, "é" * 500)])
    scores = {r.doc_id: (r.text, r.s) for r in asked.select("doc_id", "text", quality.score(F.col("text"), model).alias("s")).collect()}
    assert scores[1000][1] > scores[1001][1] + 0.3
    for text, found in scores.values():
        assert abs(found - plain_score(text, model)) < 1e-9


def test_sample_is_bounded_in_rows(spark, documents):
    from packlake.llm.common import held_out, labelled_sample

    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id bigint, quality int")
    taught = {r.doc_id for r in labels.filter(~held_out(F.col("doc_id"))).collect()}
    docs = documents([(d, f"text {k}") for d in range(40) for k in range(50 if d % 10 == 3 else 1)])
    got = labelled_sample(docs, labels, "quality", 1000).collect()
    assert {r.doc_id for r in got} == taught and len(got) == len(taught)


@pytest.mark.parametrize("which", [quality, toxicity])
def test_classifiers_odd_rows(spark, clashing, which):
    label = {quality: "quality", toxicity: "toxic"}[which]
    docs = clashing([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "x" * 50_000), (4, "good day")])
    none = spark.createDataFrame([], f"doc_id bigint, {label} int, text string")
    one_side = spark.createDataFrame([(3, 1, "t"), (4, 1, "t"), (None, 0, "t"), (2, None, "t")], f"doc_id bigint, {label} int, text string")
    for labels, expected in ((none, 0.5), (one_side, 1.0)):
        model = which.fit(docs, labels)
        assert {r.score for r in docs.select(which.score(F.col("text"), model).alias("score")).collect()} == {expected}
    both = spark.createDataFrame([(d, d % 2) for d in range(100, 160)], f"doc_id bigint, {label} int")
    more = clashing([(d, "you idiot and moron " * 5 if d % 2 else "a fine day out here " * 5) for d in range(100, 160)]).unionByName(docs)
    scores = more.select("doc_id", "text", which.score(F.col("text"), which.fit(more, both)).alias("score")).collect()
    assert len(scores) == 66 and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if not r.text}) == 1
    assert more.filter("false").select(which.score(F.col("text"), which.fit(more, both))).count() == 0


def distance(a, b):
    """Edits between two words, neighbours exchanged being one."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton():
    words = "idiot moron loser pathetic worthless disgusting clown scum".split()
    lexicon = Lexicon({w: 2.0 for w in words}, {"abc": 3.0}, set())
    rng = random.Random(1)
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k, how = rng.randrange(len(w)), rng.random()
            if how < 0.3:
                w[k] = rng.choice("abcdeiost")
            elif how < 0.5 and len(w) > 2:
                w.pop(k)
            elif how < 0.7:
                w.insert(k, rng.choice("abcdeiost"))
            elif k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        w = "".join(w)
        assert lexicon.near(w)[0] == max([2 * (1 - 0.25 * distance(t, w)) for t in words if distance(t, w) <= Lexicon.limit(len(t))], default=0)
    assert lexicon.weight("abcdef") == 3.0 and lexicon.weight("1diot") == 1.8


def test_quotation_lowers_evidence():
    known = toxicity.Known(Lexicon({"idiot": 2.0}, {}, set()))
    plain, quoted, told = (toxicity.evidence(t, known)[1] for t in ("that idiot again", 'the word "idiot" is old', "one man said idiot again"))
    assert plain > quoted > 0 and plain > told > 0
    assert toxicity.evidence("you are an idiot", known)[1] > plain


PAGES = {
    "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; <i>two</i><br>three<p>four</article><footer>f</footer>": "Head\n\nOne & two three\n\nfour",
    "<body><div class='cookie-notice'>c</div><main><p>a</p><aside>s</aside><form>f</form><div id=comments><article>r</article></div></main>": "a",
    "<body><header>h</header><div><p>text</p></div><script>if (a<b) '</p>'</script><style>p{}</style><div class=no-sidebar>kept</div>": "text\n\nkept",
    "<article class=comment>c</article><article>x<!-- no --><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>": "x\n\n1\n\n2\n\n3\n\n4",
    "a < b &lt; c\n\n d": "a < b < c d",
    "": "",
    "<p": "",
}


def test_pages(spark):
    rows = [(k, f"http://h{k}.example/x", page) for k, page in enumerate(PAGES)] + [(100, None, None), (None, "nonsense", "<p>x"), (0, "http://h0.example/x", next(iter(PAGES)))]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS texts", "3 AS text", "4 AS links"))
    expected = [(k, t) for k, t in enumerate(PAGES.values())] + [(100, ""), (-1, "x"), (0, next(iter(PAGES.values())))]
    got = out.collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in got) == sorted(expected)
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_page_template(spark):
    """A text on every page of a host is the template's; a list of links is a menu; a text on some pages is content."""
    page = "<html><body><div><a href=/>Home</a><a href=/{k}>Item {k}</a></div><div><p>Subscribe now</p><p>{own}</p></div></body></html>"
    rows = [(k, "https://host.example/" + str(k), page.format(k=k, own="shared text" if k % 2 else f"own text {k}")) for k in range(20)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: "shared text" if k % 2 else f"own text {k}" for k in range(20)}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    vectors = [(centres[rng.integers(30)] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for _ in range(3000)]
    vectors[500:1500] = [vectors[40]] * 1000  # one vector holds a third of the rows
    rows = [(k, v) for k, v in enumerate(vectors)]
    odd = [(20_000, None), (20_020, [0.0] * 16), (20_040, [float("nan")] * 16), (20_060, [1.0] * 15 + [None]), (20_080, [float("inf")] * 16), (None, vectors[0]), (0, vectors[0]), (20_100, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "2 AS leaf", "3 AS qid")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = np.array(vectors, dtype=np.float32).astype(float)
    found = total = 0
    assert set(got) == set(range(0, 3000, 20))
    for q, hits in got.items():
        hits.sort()
        scores = np.zeros(len(exact))
        for d in range(16):
            scores += exact[q, d] * exact[:, d]
        best = [k for k in np.lexsort((np.arange(len(exact)), -scores)) if k != q][:20]
        assert [h[0] for h in hits] == list(range(1, 21)) and all(h[2] == scores[h[1]] for h in hits)
        assert [h[1] for h in hits] == sorted((h[1] for h in hits), key=lambda k: (-scores[k], k))
        found += len({h[1] for h in hits} & set(best))
        total += 20
    assert found / total > 0.9
    assert ann.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]


def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    """Small bundles and blocks give the same hits as one; a far query still finds enough."""
    pick = np.random.default_rng(4)
    points = np.vstack([c + 0.1 * pick.normal(size=(60, 8)) for c in pick.normal(size=(12, 8))] + [[[50.0] * 8]])
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(points)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    ask = (F.col("vec_id") % 20 == 0) | (F.col("vec_id") == len(points) - 1)
    whole = sorted(map(tuple, ann.search(df, ask).collect()))
    monkeypatch.setattr(ann, "PART", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, ann.search(df, ask).collect())) == whole
    queries = {r[0] for r in whole}
    assert len(whole) == 20 * len(queries) and len(points) - 1 in queries


def test_pipeline(spark, clashing, tmp_path):
    """Each stage on small tables with odd rows; every stage but the last returns the columns of documents."""
    rng = random.Random(4)
    good = lambda n: " ".join(rng.choice(["day", "river", "house", "tree", "walk", "green", "stone"]) + str(rng.randrange(99)) for _ in range(n))
    line = good(60)
    rows = [(d, f"{good(50)}\n{good(30)}" if d % 3 else "### $$$ *** " * 40, f"s{d % 4}") for d in range(120)]
    rows += [(200, f"{line}\n{good(40)}", "s0"), (201, f"{good(40)}\n{line}", "s0"), (202, None, None), (203, "", "s1"), (None, good(20), "s1"), (1, rows[1][1], "s1")]
    docs = clashing([r[:2] for r in rows]).drop("source").join(spark.createDataFrame([(r[0], r[2]) for r in set(rows) if r[0] is not None], "doc_id bigint, source string"), "doc_id", "left")
    labels = spark.createDataFrame([(d, int(d % 3 > 0), 0) for d in range(120)], "doc_id bigint, quality int, toxic int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    made = spark.read.parquet(f"{folder}/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, made, folder)
        assert made.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        made.write.parquet(f"{folder}/{k}")
        made = spark.read.parquet(f"{folder}/{k}")
        counts.append(made.count())
        if k == 0:
            assert not [r for r in made.collect() if r.text and r.text.startswith("###")]
        if k == 1:
            assert [r.text.count("\n") for r in made.filter("doc_id = 201").collect()] == [0]
    assert counts[0] < len(rows) and counts[2] <= counts[1]
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = f"{folder}/empty"
    docs.filter("false").write.parquet(f"{empty}/documents.parquet")
    labels.filter("false").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
