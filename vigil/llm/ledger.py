"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document: its measurement is stored as a column and its failure as a bit of `fails`.
Policies are versioned sets of rules, that is masks, applied afterwards with one bitwise AND; ablations (what a rule costs,
alone or beside the others) are bitwise aggregations over the ledger, without reading a text again.

Defined cases: null text counts as empty; a text without words has zero measurements and fails `few_words`; repeated rows
give a row each; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WHITE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: windows are sorted with their positions, so equal ones are
    neighbours; covered words follow from the gaps between the sorted positions."""
    size = F.size(words)
    windows = F.transform(F.slice(words, 1, F.greatest(size - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def positions(s: Column) -> Column:
        def repeated(x: Column, n: Column) -> Column:
            # beyond either end stands null
            return F.coalesce(F.get(s, n - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, n + 1)["w"] == x["w"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return let(F.sort_array(windows), lambda s: let(positions(s), covered))


def measures(text: Column) -> dict[str, Column]:
    """Measurements of a text. The words and the lines are each split once; what needs them stands inside one `let`."""
    words = F.filter(F.split(text, WHITE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words")))
    of_lines = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    return {"__w": of_words, "word_chars": left(WHITE), "n_symbols": left("[^#*$%&|<>]+"), "__l": of_lines, "n_upper": left("[^\\p{Lu}]+"), "n_digits": left("[^0-9]+")}


#: Bit number = place in this list; new rules are appended, so old ledgers keep their meaning. A ledger says which version of the list it was made by:
#: SINCE[version] is how many rules that version has.
RULES_VERSION, SINCE = 1, {1: 8}
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    "capitals": "2 * n_upper > word_chars",
    "digits": "5 * n_digits > word_chars",
    "few_distinct_words": "n_words >= 50 AND 20 * n_distinct_words < n_words",
}


#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals", "digits"),
}
PRODUCTION = "v1"


def mask(names: tuple[str, ...] | list[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(x) for x in set(names))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fails (a long, bit i: rule i failed), rules_version. Made to be stored: policies and ablations read only this."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").alias("doc_id"), *[v.alias(k) for k, v in measures(text).items()])
    df = df.select("doc_id", "__w.n_words", "word_chars", "n_symbols", "__l.n_dup_lines", "__l.n_lines", "__w.n_repeat_words", "__w.n_distinct_words", "n_upper", "n_digits")
    bits = [F.when(r, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(map(F.expr, RULES.values()))]
    fails = bits[0]
    for b in bits[1:]:
        fails = fails.bitwiseOR(b)
    return df.withColumns({"fails": fails, "rules_version": F.lit(RULES_VERSION)})


def apply_policy(rows: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """Adds base_failed and kept (no rule of the policy or of the base failed; null for rows of a ledger older than one of the rules)."""
    names = [*POLICIES["base"], *POLICIES[version]]
    needed = min(v for v, n in SINCE.items() if n > max(map(list(RULES).index, names)))
    bad = lambda names: F.col("fails").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return rows.withColumns({"base_failed": bad(POLICIES["base"]), "kept": F.when(F.col("rules_version") >= needed, ~bad(names))})


def ablation(rows: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects (kept without it), and the policy's total; one pass over
    a ledger that has been stored."""
    names = POLICIES[version]
    hit = F.col("fails").bitwiseAND(F.lit(mask(names)).cast("long"))
    aggs = [F.count_if(hit != 0).alias("rejected")]
    for n in names:
        b = F.lit(mask([n])).cast("long")
        aggs += [F.count_if(hit.bitwiseAND(b) != 0).alias(f"{n}_fails"), F.count_if(hit == b).alias(f"{n}_alone")]
    one = rows.agg(*aggs)
    return one.select("rejected", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_fails").alias("fails"), F.col(f"{n}_alone").alias("only_this")) for n in names])).alias("r")).select("r.*", "rejected")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS k(o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^0-9]+', '', 'g'))::BIGINT AS n_digits
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 2 * n_upper > word_chars OR 5 * n_digits > word_chars) AS kept FROM b
"""
