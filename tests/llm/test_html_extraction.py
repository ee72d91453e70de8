import numpy as np

from ridgeline.llm import html_extraction as hx

MENU = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(4))


def page(i, body):
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{MENU}</ul></nav><div class='ad'>buy this thing now {i}</div><article>{paragraphs}</article><footer>all rights kept {i}</footer></body></html>"


def bodies(n):
    return [[f"paragraph {k} of page {i} says that many words stand here, number {i * k}." for k in range(2 + i % 3)] for i in range(n)]


def test_blocks():
    got = hx.blocks("<p>one<p>two <b>bold</b><script>x</script><!-- no --><ul><li>a<li>b</ul> tail &amp; end")
    assert [b[1] for b in got] == ["one", "two bold", "a", "b", "tail & end"]
    assert hx.blocks("<script>never ends") == [] and hx.blocks("no tags") == [((), "no tags", 0.0)]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    offsets = np.array([0, 3, 3, 7])
    x = rng.normal(size=(7, hx.DIMS))
    y = rng.integers(0, 2, 7).astype(float)
    model = hx.Labeller([rng.normal(0, 0.3, s) for s in [(hx.DIMS, 8), (2, 8)] * 2 + [(5,)]])
    _, grads = model.gradients(x, offsets, y, np.array([0, 2]))
    for k, w in enumerate(model.weights):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)]:
            old, step = w[at], 1e-5
            w[at] = old + step
            up, _ = model.gradients(x, offsets, y, np.array([0, 2]))
            w[at] = old - step
            down, _ = model.gradients(x, offsets, y, np.array([0, 2]))
            w[at] = old
            assert abs((up - down) / (2 * step) - grads[k][at]) < 1e-5


def test_labels_depend_on_the_whole_page():
    rng = np.random.default_rng(1)
    model = hx.Labeller([rng.normal(0, 0.5, s).astype(np.float32) for s in [(hx.DIMS, 16), (4, 16)] * 2 + [(9,)]])
    x = rng.normal(size=(6, hx.DIMS)).astype(np.float32)
    a = model.probabilities(x, np.array([0, 6]))
    y = x.copy()
    y[5] += 1
    assert abs(model.probabilities(y, np.array([0, 6]))[0] - a[0]) > 1e-6
    y = x.copy()
    y[0] += 1
    assert abs(model.probabilities(y, np.array([0, 6]))[5] - a[5]) > 1e-6


def test_content_of_held_out_pages(spark):
    own = bodies(120)
    pages = spark.createDataFrame([(i, f"http://x.org/en/{i}", page(i, b)) for i, b in enumerate(own)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(own[:60])], "doc_id long, text string")
    got = {r.page_id: r.text for r in hx.extract(pages, docs).collect()}
    assert sum(got[i] == "\n".join(own[i]) for i in range(60, 120)) >= 57


def test_awkward_pages(spark):
    own = bodies(20)
    rows = [(i, f"http://x.org/en/{i}", page(i, b)) for i, b in enumerate(own)]
    rows += [(None, "http://x.org/en/3", "<p>a</p>"), (30, None, None), (31, "", ""), (32, "x", "<div></div>"), (33, "x", "<p>w</p>" * 5000), (1, rows[1][1], rows[1][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    docs = spark.createDataFrame([(i, "\n".join(b), None) for i, b in enumerate(own)] + [(None, None, None)], "doc_id long, text string, html string")
    got = hx.extract(pages, docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[30].text is None and by[30].n_blocks == 0 and by[31].text == "" and by[32].text == "" and by[33].n_blocks == 5000
    assert hx.extract(pages.where("false"), docs).count() == 0
    every = hx.extract(pages, docs.where("false")).collect()
    assert all(r.n_kept == r.n_blocks for r in every)
