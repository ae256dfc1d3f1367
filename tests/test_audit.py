import pytest

from foliate.operators import audit

GOOD = '---\nvendor: alpha\nid: "1"\nnum: "1.1"\ntitle: "T"\ncategory: setup\nsource: "M pp.1-2"\n---\n\n# 1.1 T\n\n'


def rules(spark, text, images=()):
    pages = spark.createDataFrame([("alpha", "p", text)], "vendor string, slug string, text string")
    inventory = spark.createDataFrame([(i,) for i in images], "path string")
    return sorted((r["rule"].split()[0], r["line_no"], r["n"], r["detail"]) for r in audit.audit(pages, inventory).collect())


def test_clean_page(spark):
    assert rules(spark, GOOD + "text\n\n| a | b |\n|---|:-:|\n| 1 \\| 2 | x |\n\n![f](/images/a.webp)\n[l](/alpha/p1/#x) [m](../a.md) [h](https://x)\n", ["images/a.webp"]) == []


@pytest.mark.parametrize(
    "text,want",
    [
        (None, [("Q1", 0, 1, "")]),
        ("no front matter", [("Q2", 0, 1, "")]),
        (GOOD.replace('num: "1.1"\n', ""), [("Q3", 0, 1, "num"), ("Q5", 0, 1, "1.1 T")]),
        (GOOD + "# two\n", [("Q4", 0, 1, "2")]),
        (GOOD.replace("# 1.1 T", "# 1.1 U"), [("Q5", 0, 1, "1.1 U")]),
        (GOOD + "a � b\n", [("Q6", 0, 1, "")]),
        (GOOD + "\n", [("Q7", 0, 1, "")]),
        (GOOD + "x ]( ) y\n", [("Q8", 0, 1, "")]),
        (GOOD + "[a](b c)\n", [("Q9", 0, 1, "[a](b c)")]),
        (GOOD + "[label\n\n![f](//x/y)\n", [("Q10", 0, 1, "")]),
        (GOOD + "## ● item\n", [("Q11", 0, 1, "")]),
        (GOOD + "注意\n", [("Q12", 0, 1, "")]),
        (GOOD + "|a|b|\n|--|--|\n|1|\n", [("Q13", 4, 1, "")]),
        (GOOD + "|a|b|\n", [("Q13", 4, 1, "")]),
        (GOOD + "![f](a.webp)\n", [("Q14", 0, 1, "a.webp")]),
        (GOOD + "```\n", [("Q15", 0, 1, "")]),
        (GOOD + "x\n x \n|a|\n", [("Q13", 6, 1, ""), ("Q16", 5, 1, "")]),
        (GOOD + "x\n\nx\n---\n---\n", []),
        (GOOD + "ださい。\n択\n", [("Q17", 4, 1, ""), ("Q17", 5, 1, "")]),
        (GOOD + "参照してく\n", [("Q18", 4, 1, "")]),
        (GOOD + "本書と本書 • 《x》\n", [("Q19", 0, 1, ""), ("Q19", 0, 2, ""), ("Q19", 0, 2, "")]),
    ],
)
def test_rules(spark, text, want):
    assert rules(spark, text) == want


def test_common_guides_need_no_number(spark):
    assert rules(spark, GOOD.replace("vendor: alpha", "vendor: common").replace('num: "1.1"\n', "").replace("# 1.1 T", "# T")) == []


def test_totals_and_verdict(spark):
    pages = spark.createDataFrame([("alpha", "a", GOOD + "|a|\n|-|\n![x](y)\n"), ("alpha", "b", GOOD + "• •\n"), ("alpha", "c", None)], "vendor string, slug string, text string")
    findings = audit.audit(pages, spark.createDataFrame([("y",)], "path string"))
    assert tuple(audit.totals(pages).first()) == (3, 1, 1)
    assert [tuple(r) for r in audit.warning_totals(findings).collect()] == [("Q19 raw bullet glyph", 2)]
    assert tuple(audit.verdict(findings).first()) == (1, False)
    assert tuple(audit.verdict(findings.where("rule like 'Q19%'")).first()) == (0, True)
