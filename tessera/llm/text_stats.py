"""Statistics of whole texts as DataFrame expressions, one pass and no shuffle.

Windows of three words are compared by a 64-bit hash; two different windows of one text share it with a chance of about
n * n / 2**65, 1e-11 for 20,000 words. A null text has all statistics zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, let, words_of

#: Characters counted, as the inside of a regex class.
COUNTED = {"n_symbols": "#*$%&|<>", "n_upper": "\\p{Lu}", "n_digits": "0-9", "n_ends": ".,", "n_shouts": "!?"}
#: What ``with_stats`` adds, all long.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "n_upper", "n_digits", "n_ends", "n_shouts", "n_stops")
#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = "the of and to in is that for it as with de la el en que los le les des et du un une der die das und ist den von zu".split()


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window which the text holds twice or more, the first one included."""
    windows = F.greatest(F.size(words) - 2, F.lit(0))
    threes = F.arrays_zip(F.slice(words, 1, windows).alias("a"), F.slice(words, 2, windows).alias("b"), F.slice(words, 3, windows).alias("c"))
    placed = F.sort_array(F.transform(threes, lambda w, i: F.struct(F.xxhash64(w).alias("h"), i.alias("i"))))

    def covered(at: Column) -> Column:
        pairs = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(places, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), step)["n"]

    return let(placed, covered)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct column ``stats`` of ``STATS``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def stats(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        few = F.regexp_replace(body, "[^\\p{Lu}0-9.,!?#*$%&|<>]+", "")  # a short text with all that is counted
        of_text = F.struct(
            F.size(lines).alias("n_lines"),
            F.size(F.array_distinct(lines)).alias("distinct_lines"),
            *[F.length(F.regexp_replace(few, f"[^{kept}]+", "")).alias(n) for n, kept in COUNTED.items()],
        )
        of_words = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_repeat_words": repeat_words(words),
            "n_stutters": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda same: same)),
            "n_stops": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        }
        value = lambda t, n: of_words[n] if n in of_words else t["n_lines"] - t["distinct_lines"] if n == "n_dup_lines" else t[n]
        return let(of_text, lambda t: F.struct(*[value(t, n).cast("bigint").alias(n) for n in STATS]))

    return docs.withColumn("stats", let(words_of(F.col(text)), stats))


def shares(stats: Column) -> dict[str, Column]:
    """Sizes on a log scale and shares between 0 and about 1, as doubles; all finite for any text."""
    n = {x: stats[x].cast("double") for x in STATS}
    per = lambda a, b: n[a] / F.greatest(n[b], F.lit(1.0))
    others = n["n_symbols"] + n["n_digits"] + n["n_ends"] + n["n_shouts"]
    return {
        "log_words": F.log1p(n["n_words"]),
        "word_length": F.log1p(per("word_chars", "n_words")),
        "symbols": F.log1p(100 * per("n_symbols", "word_chars")),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "line_words": F.log1p(per("n_words", "n_lines")),
        "stutters": per("n_stutters", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "letters": (n["word_chars"] - others) / F.greatest(n["word_chars"], F.lit(1.0)),
        "digits": F.log1p(100 * per("n_digits", "word_chars")),
        "ends": F.log1p(100 * per("n_ends", "n_words")),
        "shouts": F.log1p(100 * per("n_shouts", "n_words")),
        "stops": per("n_stops", "n_words"),
    }
