"""Sitemap walks: a ring of indexes, chains, shared maps, and how many rows a walk writes on its way."""
from rosterlake.operators import pages as P


def index(*locs):
    return "<?xml version='1.0'?><sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in locs) + "</sitemapindex>"


def leaf(*locs):
    return "<?xml version='1.0'?><urlset>" + "".join(f"<loc>{x}</loc>" for x in locs) + "</urlset>"


def walked(docs):
    """The same by plain sets."""
    out = set()
    for top in {u for u, _ in docs if u is not None}:
        seen, todo = {top}, [top]
        while todo:
            at = todo.pop()
            for u, b in docs:
                if u == at and "<loc>" in b:
                    locs = [x.split("</loc>")[0] for x in b.split("<loc>")[1:]]
                    if "<sitemapindex" in b:
                        todo += [x for x in locs if x not in seen]
                        seen |= set(locs)
                    else:
                        out |= {(top, x) for x in locs if "contact" in x}
    return out


def test_walks_of_any_shape(spark):
    docs = [("c0", index("c1")), *((f"c{i}", index(f"c{i + 1}", "c3")) for i in range(1, 20)), ("c20", index("m1", "m2", "nowhere")), ("m1", leaf("u/contact/1", "u/news")),
            ("m2", leaf("u/contact/1", "u/contact/2")), ("m3", leaf("u/news")), ("self", index("self", "m2")), ("both", index("m1")), ("both", leaf("u/contact/3")),
            ("lead", index("both", "self")), (None, index("m1")), ("nulls", index("m3")), (None, leaf("u/contact/9"))]
    got = [tuple(r) for r in P.sitemap_contact_pages(spark.createDataFrame(docs, "url string, body string")).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(docs) and len(got) > 40


def test_a_ring_is_walked_without_its_maps(spark, monkeypatch):
    docs = [(f"r{i}", index(f"r{(i + 1) % 10}", *([f"m{j}" for j in range(200)] if i == 9 else []))) for i in range(10)] + [(f"m{j}", leaf(f"u/contact/{j}")) for j in range(200)]
    written = []

    def counted(f):
        def run(df):
            out = f(df)
            written.append(out.count())
            return out
        return run

    for name in ("cut_lineage", "stored"):
        monkeypatch.setattr(P, name, counted(getattr(P, name, None)), raising=False)
    got = P.sitemap_contact_pages(spark.createDataFrame(docs, "url string, body string"))
    assert got.count() == 2200 and sum(written) < 600  # 200 pages, 210 links; the walk itself has 10 rows
