"""The rule index against every rule on every symbol."""

import fnmatch
import random
import re

import pytest

from skeinwork.operators import ownership


def plain(nodes, rules):
    out = set()
    for key, label, file in nodes:
        for n, kind, pattern in rules:
            if kind == "symbol" and label == pattern:
                out.add((key, 3, n))
            if kind == "name" and label is not None and re.search(pattern, label):
                out.add((key, 2, n))
            if kind == "path" and file is not None and fnmatch.fnmatchcase(file, pattern):
                out.add((key, 1, n))
    return out


def got(spark, nodes, rules):
    n = spark.createDataFrame(nodes, "id string, label string, file string")
    r = ownership.rules_of(spark.createDataFrame(rules, "ordinal int, kind string, pattern string"))
    found = [(x.id, x.tier, x.ordinal) for x in ownership.matches(n, r).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize(
    ("regex", "literal"),
    [
        ("^Part[.]Brand#1", "Brand#1"), ("abc", "abc"), ("abc|def", ""), ("ab+cde", "cde"), ("abcd?e", "abc"), ("abcd{2}ef", "abc"), ("x(abc|d)yz", "yz"), ("(abc", ""), ("[abc", ""),
        (r"a\.bc\d", "a.bc"), (r"\x41bcd", ""), (r"\Qa.b\E", ""), ("(?i)abc", ""), ("(?s)^src/.*$", "src/"), ("(a[)]b)cd", "cd"), ("[^]]abc", "abc"), ("[a[b]]xyz", ""), ("ab*?cd", "cd"), ("", ""), ("é+ab.*", "ab"),
        ("a++bcd", "bcd"), (r"\bword\b", "word"), ("a{1,", ""),
    ],
)
def test_required_literal(regex, literal):
    assert ownership.required_literal(regex) == literal


def test_index_finds_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(ownership, "LOOSE", 3)
    for seed in range(3):
        rng = random.Random(seed)
        part = lambda n: "".join(rng.choice("abc.é/") for _ in range(n))
        nodes = [(f"n{k}", rng.choice([None, part(rng.randrange(12)), "core.abcabcabc"]), rng.choice([None, "src/abc/cba.py", part(rng.randrange(12))])) for k in range(80)]
        labels = [n[1] for n in nodes if n[1]]
        rules = [(1000, "symbol", rng.choice(labels)), (1001, "name", "^"), (1002, "path", "*"), (1003, "name", "a+b|c"), (1004, "name", "abcabcabc$"), (1005, "path", "src/*/[!b]ba.p?"), (1006, "other", "abc")]
        for n in range(60):
            word = re.escape(part(rng.randrange(1, 6)))
            rules.append((n, *rng.choice([("name", word), ("name", f"^{word}[abc]*"), ("name", f"{word}.{re.escape(part(3))}"), ("path", f"*{part(rng.randrange(1, 5))}*"), ("path", part(3) + "?*"), ("symbol", rng.choice(labels))])))
        assert got(spark, nodes, rules) == plain(nodes, [r for r in rules if r[1] != "other"])


def test_no_nested_loop_and_no_limit(spark):
    nodes = spark.range(300).selectExpr("concat('n', id) id", "concat('Order.k', id, '.x') label", "concat('app/o', id, '/f.py') file")
    rules = spark.range(20_000).selectExpr("id ordinal", "if(id % 2 = 0, 'name', 'path') kind", "if(id % 2 = 0, concat('k', id, '[.]'), concat('app/o', id, '/*')) pattern")
    df = ownership.matches(nodes, ownership.rules_of(rules))
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.ordinal) for r in df.collect()} == {(f"n{k}", k) for k in range(300)}


def test_no_rules(spark):
    nodes = [("n", "abc", "f.py")]
    assert got(spark, nodes, []) == set()
    assert got(spark, [], [(1, "name", "abc")]) == set()
    assert got(spark, nodes, [(1, "name", "zzz"), (2, "symbol", "abc")]) == {("n", 3, 2)}


def test_a_class_of_one_character_is_part_of_the_literal():
    assert [ownership.required_literal(x, classes=True) for x in ("^Order[.]k17[.]x$", "[.]k3[.]", "ab[.]*cd", "ab[.]+c", "[.]?abc", "[^]abc", "a[.]{2}b", "[[]x")] == ["Order.k17.x", ".k3.", "ab", "ab.", "abc", "", "a", ""]
