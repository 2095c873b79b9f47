import math
import random
import re
from collections import Counter

from logfathom.llm.quality_rules import RULES, figures, quality_filter


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_figures(spark, docs, documents, empty):
    extra = [(1000, "a b c d e a b c d e f"), (1001, "x x x x x x x"), (1002, "l1\nl1\r\n \nl2\nl1"), (1003, "|# $% <a> b\tc\vd\fe")]
    df = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(i, t, None, None) for i, t in extra], "doc_id long, text string, lang string, source string"))
    got = sorted(tuple(r) for r in figures(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect() if r.doc_id is not None)
    assert got == sorted((i, *brute(t)) for i, t in documents + extra if i is not None)
    assert quality_filter(empty).count() == 0 and quality_filter(docs).count() == len(documents)


def test_fences(spark, prose):
    items = [(i, prose(60, i), "en", f"s{i % 2}") for i in range(200)] + [(900, " ".join(w + "###" for w in prose(60, 3).split()), "en", "s0"), (901, "few words", "en", "s1"), (902, "again and again and again and again and again and again and", "en", "s1"), (903, prose(60, 903), None, None), (904, None, "en", "s0")]
    got = {r.doc_id: r for r in quality_filter(spark.createDataFrame(items, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i].kept for i in range(200)) >= 198
    assert not got[900].kept and not got[900].base_failed
    assert all(got[i].base_failed and not got[i].kept for i in (901, 902, 904))
    assert got[903].kept


def test_fences_follow_the_group(spark, prose):
    """A text with a tenth of its words repeated, under the base rule's fifth, goes where others have none and stays where
    many do; few symbols and few repeated lines go where others have none."""
    def again(i):
        t = prose(100, i).replace("\n", "")
        return t + " " + " ".join(t.split()[:5])

    lines = "\n".join(prose(12, 3000 + i).replace("\n", "") for i in range(8))
    some = prose(100, 2002).replace("\n", "").split(" ")
    items = [(i, prose(100, i).replace("\n", ""), "en", "none") for i in range(100)] + [(1000 + i, again(i) if i % 2 else prose(100, i), "en", "many") for i in range(100)]
    items += [(2000, again(7), "en", "none"), (2001, again(7), "en", "many"), (2002, " ".join([some[0] + "#", *some[1:]]), "en", "none"), (2003, lines + "\nko ti\nko ti", "en", "none")]
    got = {r.doc_id: r for r in quality_filter(spark.createDataFrame(items, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in (2000, 2001, 2002, 2003)) and 0.05 < got[2000].n_repeat_words / got[2000].n_words < 0.2
    assert not got[2000].kept and got[2001].kept
    assert not got[2002].kept and not got[2003].kept
    assert sum(got[i].kept for i in range(100)) >= 97


def quantile(values, q):
    return sorted(values)[max(math.ceil(q * len(values) - 1e-9) - 1, 0)]


def brute_kept(items, spread=3.0, prior=20.0):
    """kept by doc_id, from exact quantiles of each source, each language and all, a smaller group leaning on the wider."""
    rates, failed = {}, {}
    for i, t, lang, source in items:
        n, chars, symbols, lines, repeats = brute(t)
        failed[i] = n < 10 or 100 * repeats > 20 * n
        m = max(n, 1)
        rates[i] = {"symbol_rate": symbols / m, "word_length": chars / m, "dup_line_rate": lines / m * 10, "repeat_rate": repeats / m}

    def fences(ids):
        out = {}
        for c in RULES:
            q = lambda x: quantile([rates[i][c] for i in ids], x)  # noqa: B023, E731
            tail = 1.5 * (q(0.98) - q(0.75)) if c in ("dup_line_rate", "repeat_rate") else spread * min(q(0.95) - q(0.5), q(0.5) - q(0.05))
            room = max(spread * (q(0.75) - q(0.25)), tail)
            out[c] = q(0.75) + room
            out["least"] = q(0.25) - room if c == "word_length" else out.get("least")
        return out

    good = [x for x in items if not failed[x[0]]]
    lean = lambda own, n, wide: {c: (own[c] * n + wide[c] * prior) / (n + prior) for c in own}
    of = lambda lang, source=...: [x[0] for x in good if x[2] == lang and source in (..., x[3])]
    whole, kept = fences([x[0] for x in good]), {}
    for i, _, lang, source in items:
        if not (own := of(lang, source)):
            kept[i] = not failed[i]
            continue
        f = lean(fences(own), len(own), lean(fences(of(lang)), len(of(lang)), whole))
        kept[i] = not failed[i] and all(rates[i][c] <= f[c] for c in RULES) and rates[i]["word_length"] >= f["least"]
    return kept


def test_kept_against_exact_quantiles(spark, prose):
    """Sources of 1 to 150 documents, in two languages and none, with every kind of flaw to every degree."""
    rng, items = random.Random(8), []
    for lang, source, n in [("en", "big", 150), ("en", "mid", 40), ("en", "one", 1), ("de", "few", 5), ("de", "some", 60), (None, None, 12), ("fr", None, 1)]:
        for _ in range(n):
            words = prose(rng.randint(30, 90), rng.random()).split(" ")
            for _ in range(rng.choice([0, 0, 0, 1, 3, 9])):
                words[rng.randrange(len(words))] += "#"
            words += words[: rng.choice([0, 0, 0, 0, 5, 7, 12])]
            text = " ".join(words) + "\nthe same line" * rng.choice([0, 0, 0, 2, 3])
            items.append((len(items), text.replace("a", "aaaaa") if rng.random() < 0.03 else text, lang, source))
    items += [(len(items), "few words", "en", "big"), (len(items) + 1, None, "it", "none")]
    got = {r.doc_id: r.kept for r in quality_filter(spark.createDataFrame(items, "doc_id long, text string, lang string, source string")).collect()}
    want = brute_kept(items)
    assert got == want and 0.05 < sum(not x for x in want.values()) / len(want) < 0.5


def test_edges(spark, empty, docs, documents):
    """A single document sets its own fence; repeated rows count each; nulls have none."""
    one = quality_filter(spark.createDataFrame([(1, "w " * 4 + "a b c d e f g # h", None, None)], "doc_id long, text string, lang string, source string")).collect()
    assert [r.kept for r in one] == [True]
    rows = quality_filter(docs).collect()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (30, 31, 32))
    assert len({(r.kept, r.n_words) for r in rows if r.doc_id == 40}) == 1 and sum(r.doc_id == 40 for r in rows) == 2
    assert quality_filter(empty).columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
