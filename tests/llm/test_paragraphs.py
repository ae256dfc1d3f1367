import itertools
import random
import re

import pytest

from foliate.llm import paragraphs as p


def shingle_set(line):
    w = re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(" \t\r\x0b\x0c"))
    w = [x for x in w if x]
    return w, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """Classes of similar paragraphs by all pairs; repeated rows count once."""
    places, sets = [], []
    for doc, text in dict.fromkeys(rows):
        for number, line in enumerate((text or "").split("\n")):
            w, s = shingle_set(line)
            if len(w) >= p.LEAST_WORDS:
                places.append((doc, number))
                sets.append(s)
    up = list(range(len(places)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(places)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    groups = {}
    for i in range(len(places)):
        groups.setdefault(top(i), []).append(places[i])
    out = {}
    for members in groups.values():
        if len(members) > 1:
            for m in members:
                out[m] = min(members)
    return out


def rows(words):
    r = random.Random(5)
    lines = [words(r.randrange(20, 120), k) for k in range(14)]
    made = [(k, "\n".join([words(30, 300 + k), lines[k], words(8, 400)])) for k in range(14)]
    for k in range(10):
        w = lines[k].split()
        w[r.randrange(len(w))] = "changed"
        made.append((20 + k, "\n".join([words(25, 500 + k), " ".join(w)])))
    made += [(40, lines[3].upper()), (41, lines[3] + "\n" + lines[3]), (42, None), (43, ""), (44, "\n\n"), (45, words(19, 1)), (46, words(19, 1)), (47, lines[5]), (47, lines[5])]
    passage = words(60, 999)
    made += [(60, f"{words(40, 61)} {passage} {words(40, 62)}"), (61, f"{words(30, 63)} {passage}"), (62, words(200, 64)), (63, words(200, 65)), (64, "")]
    return made


@pytest.mark.parametrize("bucket", [2000, 3])
def test_classes_match_brute_force(docs, words, bucket):
    data = rows(words)
    table = p._keyed(docs(data).repartition(3))
    got = {(r["doc_id"], r["number"]): r["first"] for r in p.classes(table, bucket=bucket).collect()}
    want = brute(data)
    assert set(got) == set(want)
    assert {k: v["doc_id"] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_rows_and_texts(docs, words):
    data = rows(words)
    found = {r["doc_id"]: r for r in p.repeated(docs(data)).collect()}
    assert len(found) == len({d for d, _ in data})
    want = brute(data)
    for doc, r in found.items():
        assert r["removed"] == sorted(n for (d, n), first in want.items() if d == doc and first != (d, n))
    assert found[60]["n_passage_words"] >= 20 and 60 in found[61]["first_doc_ids"]
    for clean in (42, 43, 44, 45, 46, 62, 63):
        assert (found[clean]["n_repeated"], found[clean]["n_passage_words"], found[clean]["first_doc_ids"]) == (0, 0, [])
    kept = {r["doc_id"]: r["text"] for r in p.deduplicate(docs(data)).collect()}
    for doc, text in data:
        own = (text or "").split("\n")
        assert (kept[doc] or "") == "\n".join(x for n, x in enumerate(own) if n not in found[doc]["removed"])


def test_bands_reach_the_recall():
    count, height = p.bands()
    assert 1 - (1 - 0.8**height) ** count >= 0.99 and height > 1


def test_passage_of_fifty_words_is_found(docs, words):
    for k in range(6):
        passage = words(50, 700 + k)
        data = [(1, f"{words(37 + k, 10 + k)} {passage} {words(20, 20 + k)}"), (2, f"{words(11, 30 + k)} {passage} {words(90, 40 + k)}")]
        assert all(r["n_passage_words"] >= 20 for r in p.repeated(docs(data)).collect())


def test_empty_table(docs):
    assert p.repeated(docs([])).count() == 0


def test_query_takes_short_lines(spark, words, tmp_path):
    from foliate.llm import entries

    near = words(15, 810).split()
    near[0] = "changed"  # one of eleven shingles: Jaccard 10 / 12
    texts = {1: words(15, 810), 2: " ".join(near), 3: "Same two\n" + words(12, 811), 4: "same  TWO\n" + words(12, 812), 5: "two same\n\n" + words(6, 813), 6: words(6, 813)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_repeated"], r["removed"], r["first_doc_ids"]) for r in entries.op7_paragraphs(spark, str(tmp_path)).collect()}
    assert got == {1: (1, [], []), 2: (1, [0], [1]), 3: (1, [], []), 4: (1, [0], [3]), 5: (1, [], []), 6: (1, [0], [5])}
