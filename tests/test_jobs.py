from foliate.dims import categories, vendors
from foliate.jobs import build, check

PAGE = '---\nvendor: {v}\nid: "{n}"\nnum: "1.{n}"\ntitle: "T{n}"\ncategory: {c}\nsource: "M pp.{n}-{n}"\n---\n\n# 1.{n} T{n}\n\ntext & <more>\n'


def pages(spark):
    rows = [("alpha", f"p{n}", PAGE.format(v="alpha", n=n, c="setup" if n < 3 else "debug")) for n in range(1, 5)] + [("beta", "q1", PAGE.format(v="beta", n=1, c="setup"))]
    return spark.createDataFrame(rows, "vendor string, slug string, text string")


def test_index_job(spark, tmp_path):
    common = spark.createDataFrame([("common", "setup", "# a\n# b\n")], "vendor string, slug string, text string")
    build.run(pages(spark), common, str(tmp_path), vendors(spark), categories(spark))
    assert spark.read.json(f"{tmp_path}/nav").select("vendor", "cat").distinct().count() == 3 and spark.read.json(f"{tmp_path}/nav").count() == 5 and spark.read.json(f"{tmp_path}/search").count() == 6
    assert spark.read.json(f"{tmp_path}/sitemap").select("loc").distinct().count() == 1 + 9 + 5
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/agent_index").collect()]
    assert sum(x.startswith("- [") for x in lines) == 5 and sum(x.startswith("## ") for x in lines) == 3 and sum(x.startswith("### ") for x in lines) == 3


def test_heads_and_neighbours_are_inverse(spark):
    rows = build.head(pages(spark)).collect()
    after = {(r["vendor"], r["slug"]): r["next_slug"] for r in rows}
    for r in rows:
        assert r["previous_slug"] is None or after[r["vendor"], r["previous_slug"]] == r["slug"]
        assert "<title>1." in r["head"] and "text &amp; &lt;more " in r["head"]


def test_audit_job(spark, tmp_path):
    none = spark.createDataFrame([], "path string")
    assert check.run(pages(spark), none, f"{tmp_path}/good")
    bad = pages(spark).limit(1).selectExpr("vendor", "slug", "concat(text, '![x](gone.webp)') as text")
    assert not check.run(bad, none, f"{tmp_path}/bad") and spark.read.parquet(f"{tmp_path}/bad").count() == 1


def inputs(spark, texts):
    from foliate.sources import layout_view as view

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return view.toc(docs), view.page_counts(docs), view.spans(docs), view.boxes(docs), view.cells(docs)


def test_extraction_makes_what_has_changed(spark, tmp_path, monkeypatch):
    from foliate.jobs import extract
    from foliate.operators import assemble
    from foliate.sources import corpus

    texts = {i: f"First line of {i}.\nSecond line with more words in it {i}.\n" * 3 for i in range(45)}
    out, made, build = str(tmp_path / "out"), [], assemble.assemble

    def counting(*given, **named):
        done = build(*given, **named)
        made.append({(r["vendor"], r["slug"]) for r in done.select("vendor", "slug").collect()})
        return done

    monkeypatch.setattr(assemble, "assemble", counting)
    extract.run(*inputs(spark, texts), out)
    pages = {(r["vendor"], r["slug"]): r["text"] for r in extract.pages_of(spark, out).collect()}
    assert len(pages) > 30 and made.pop() == set(pages)
    text = next(t for (v, slug), t in pages.items() if v == "gamma" and "Section 5" in t)
    assert "Second line with more words in it 5." in text and text.startswith("---\nvendor: gamma")
    catalog = spark.read.json(f"{out}/catalog")
    assert {(r["vendor"], r["slug"]) for r in catalog.collect()} == set(pages)

    # The same again: nothing is made, nothing written.
    versions = corpus.versions(spark, f"{out}/pages"), corpus.versions(spark, f"{out}/manifest")
    extract.run(*inputs(spark, texts), out)
    assert not made and versions == (corpus.versions(spark, f"{out}/pages"), corpus.versions(spark, f"{out}/manifest"))

    # One text: its section, and those that share a page with it. A run that breaks off before the manifest counts as not done.
    merge = corpus.merge_pages
    monkeypatch.setattr(corpus, "merge_pages", lambda df, root: (_ for _ in ()).throw(OSError("lost")) if root.endswith("manifest") else merge(df, root))
    texts[5] = texts[5].replace("Second", "Changed")
    try:
        extract.run(*inputs(spark, texts), out)
        raise AssertionError("the run should have failed")
    except OSError:
        first = made.pop()
    monkeypatch.setattr(corpus, "merge_pages", merge)
    extract.run(*inputs(spark, texts), out)
    assert made.pop() == first and 1 <= len(first) <= 3
    after = {(r["vendor"], r["slug"]): r["text"] for r in extract.pages_of(spark, out).collect()}
    assert {k for k in pages if after[k] != pages[k]} <= first and any("Changed line with more words in it 5." in t for t in after.values())
    extract.run(*inputs(spark, texts), out)
    assert not made
