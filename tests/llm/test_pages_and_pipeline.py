"""The block labeller on made and given pages, count-min sketches, and the pipeline as a whole."""

import numpy as np
import pytest
from odd import odd_documents
from pyspark.sql import functions as F
from riskweave.llm import counts, html_text

import corpus_pipeline


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


def test_blocks():
    page = (
        "<!-- <p>no</p> --><script>if (a<b) '</p>'</script><div class='x'>a &amp; b&nbsp;<b>c</b><br>d</div>"
        "<p>one<p>two <a href='>'>link</a></p><style>p{}</style> tail &lt; end <unclosed"
    )
    assert [b[0] for b in html_text.blocks_of(page)] == ["a & b c d", "one", "two link", "tail < end"]
    assert html_text.blocks_of("") == []


def test_unclosed_head_and_closed_drawings():
    def texts(page):
        return [b[0] for b in html_text.blocks_of(page)]

    assert texts("<html><head><title>T</title><body><article><p>Main text.") == ["Main text."]
    assert texts("<head><meta charset=x><title>T</title><style>p{}</style><script>1</script><p>Main text.") == ["Main text."]
    assert texts("<HEAD><TITLE>T</TITLE></HEAD><p>Main text.") == ["Main text."]
    for drawn in ("<svg/>", "<svg viewBox='0 > 0' class=\"a/b\" />", "<math id=x />", "<SVG\nid='x'/>"):
        assert texts(f"<p>One {drawn}two</p><p>three</p><svg><text>no</text></svg><p>four</p>") == ["One two", "three", "four"]
    assert texts("<p>a <svg width=1/>no</svg>b <svg><path d='x'/>no</svg>c <math>no</math>d</p>") == ["a b c d"]
    assert texts("<p>a <script src=x />no</script>b <svg><svg/>no</svg>c</p>") == ["a b c"]


def test_gradients():
    rng = np.random.default_rng(0)
    model = html_text.Labeller(1)
    sequences = [rng.normal(size=(n, html_text.WIDTH)) for n in (3, 5)]
    x, mask = html_text.padded(sequences)
    y = (rng.random(mask.shape) < 0.5) * mask
    _, grad = model.gradients(x, mask, y)
    for name in ("whf", "wxb", "bxf", "out"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        held = model.p[name][at]
        losses = []
        for step in (1e-5, -1e-5):
            model.p[name][at] = held + step
            losses.append(model.gradients(x, mask, y)[0])
        model.p[name][at] = held
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[name][at], rel=1e-3)


def test_held_out_layouts(model):
    pages = html_text.labelled_pages(150, seed=99)
    p = np.concatenate(model.label([a for a, _ in pages]))
    y = np.concatenate([b for _, b in pages])
    assert ((p > 0.5) == y).mean() > 0.98


def test_pages(spark, model, sf_dir):
    rows = [
        (1, "u", None),
        (2, None, ""),
        (3, "u", "<nav><a href=/>Home</a></nav><article><h1>A title of it</h1><p>First &eacute; part.</p><p>Second part, with more words.</p></article>"
                 "<div class='comments'><p>I say no.</p></div><footer>&copy; x</footer>"),
        (None, "u", "no tags at all"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extracted(table, model).collect()}
    assert got[1] == got[2] == ""
    assert got[3] == "A title of it\n\nFirst é part.\n\nSecond part, with more words."
    assert html_text.extracted(table.where("false"), model).count() == 0


def test_given_pages(spark, model, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages, model).collect()}
    same = 0
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        same += got[r["page_id"]] == "\n\n".join(b[0] for b in html_text.blocks_of(inner))
    assert same >= 0.95 * len(got)


def test_sketch_loses_nothing(spark):
    values = np.random.default_rng(4).integers(-(2**63), 2**63, 5000)
    rows = [(int(v),) for v in np.concatenate([values, values[:500], values[:3]])]
    test = counts.repeated(spark.createDataFrame(rows, "v long").repartition(7))
    found = test(values.view(np.uint64))
    assert found[:500].all() and found[500:].mean() < 0.01
    assert not counts.repeated(spark.createDataFrame([], "v long"))(values.view(np.uint64)).any()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, corpus_pipeline.stored(stage(spark, kept, sf_dir), "test-stage")
        if name != "packing":
            assert kept.columns == docs.columns and 0 < kept.count()
        if name == "quality classifier":
            ids = {r["doc_id"] for r in kept.collect()}
            clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
            assert sum(i in ids for i in clean) >= 0.95 * len(clean)
        if name == "line dedup":
            assert kept.count() == before.count()
    assert kept.select("sequence_id", "offset").distinct().count() == kept.count()


def test_pipeline_takes_odd_rows(spark, sf_dir):
    kept = odd_documents(spark)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, sf_dir), "test-odd")
        assert name == "packing" or kept.columns == columns
    assert kept.count() > 0


def test_inline_tags_do_not_part_words():
    """Only line breaks and cells stand between words; a possible break or a picture inside a word leaves it whole."""
    texts = [b[0] for b in html_text.blocks_of("<p>sp<wbr>lit wo<img src=x>rd a<b>b</b>c<br>d</p><table><tr><td>one<td>two</table>")]
    assert texts == ["split word abc d", "one two"]


def test_stray_end_tags_take_no_square_of_time():
    import time

    begin = time.time()
    n = 60_000
    page = "<div>" * n + "".join(f"w{i}</p>" for i in range(n)) + "</div>" * n
    assert len(html_text.blocks_of(page)) == n and time.time() - begin < 20
