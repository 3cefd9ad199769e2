from collections import Counter

from vigil.llm import ledger
from vigil.llm.common import written


def brute(text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_of_odd_rows(nasty, empty):
    rows = ledger.apply_policy(ledger.ledger(nasty)).collect()
    assert len(rows) == nasty.count()
    text = {r.doc_id: r.text for r in nasty.collect()}
    for r in rows:
        want = brute(text[r.doc_id])
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert ledger.ledger(empty).count() == 0


def test_overlapping_windows_count_each_word_once(spark):
    docs = spark.createDataFrame([(1, "a b c a b c x y z"), (2, "a a a a a"), (3, "a b a b a")], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in ledger.ledger(docs).collect()}
    assert got == {1: 6, 2: 5, 3: brute("a b a b a")[4]}


def test_ablation_equals_recount(spark):
    rows = written(ledger.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), "ledger")
    held = rows.collect()
    names = list(ledger.RULES)
    hit = [x.fails & ledger.mask(ledger.POLICIES["v1"]) for x in held]
    for r in ledger.ablation(rows).collect():
        bit = 1 << names.index(r.rule)
        assert (r.fails, r.only_this, r.rejected) == (sum(bool(h & bit) for h in hit), sum(h == bit for h in hit), sum(h != 0 for h in hit))


def test_no_python_in_the_plan(spark, capsys):
    ledger.apply_policy(ledger.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
