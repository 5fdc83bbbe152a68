"""Quality rules, line first, with DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate), failing lines are removed, and a document that
loses too much of its text that way, or fails the base statistics, is rejected. A line of any length is judged by shares:
what follows its last closing mark may be half of it at most (all of it, where there is no mark), sentences with a phrase
of boilerplate may be half of its sentences' characters, and separators and symbols count against its length. So a notice
of one sentence falls however long it is, and prose that says "click here" in one sentence of several stays. All of it is
one projection: no shuffle, no Python, so the cost is linear in the text and a hot source or a long document moves
nothing.

Defined cases: a null or empty text has no words and fails the base; lines without a word are neither kept nor lost,
they stay; rows are judged one by one, so repeated rows and ids get equal verdicts; an empty table gives an empty
result; other columns pass through `clean_documents`, and working columns are dropped again (they start with `_lk_`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import SPACE, words_of

# The line rules. Regular expressions in the subset that Java and RE2 share.
THROUGH_LAST_MARK = r"(?s)^.*[.!?:;\x{2026}][\x22\x27)\]\x{201D}\x{00BB}]*(?:[ \t\r]+|$)"
SENTENCE_END = r"[.!?\x{2026}]+"
BESIDE_NAVIGATION = r"[^|\x{2022}]+"
BESIDE_SHOUTING = r"[^!#*$%&]+"
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|javascript|lorem ipsum"
    r"|licensed under the|released under the|copyright \(c\)|click here|sign up now|subscribe to our|powered by"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl\x{00E4}rung|verwendet cookies|hier klicken|newsletter abonnieren"
    r"|tous droits r\x{00E9}serv\x{00E9}s|conditions d.utilisation|politique de confidentialit\x{00E9}|utilise des cookies|cliquez ici|abonnez-vous"
    r"|todos los derechos reservados|condiciones de uso|pol\x{00ED}tica de privacidad|utiliza cookies|haz clic aqu\x{00ED}|suscr\x{00ED}bete"
)
HAS_WORD = r"[^\x20\x09-\x0D]"

#: Characters of a line for each of which a separator or five symbols are allowed.
EVERY = 40

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50


def _passes(line: str) -> str:
    """SQL: does a line pass the punctuation, navigation and boilerplate rules?"""
    # Most lines hold no phrase; only the others are cut into sentences.
    sentences = f"split(lower({line}), r'{SENTENCE_END}')"
    size = lambda parts: f"length(array_join({parts}, ''))"
    notice = f"2 * {size(f"filter({sentences}, s -> s rlike r'{BOILERPLATE}')")} > {size(sentences)}"
    return (
        f"(2 * length(rtrim(' \\t\\r', regexp_replace({line}, r'{THROUGH_LAST_MARK}', ''))) <= length({line})"
        f" AND NOT (lower({line}) rlike r'{BOILERPLATE}' AND {notice})"
        f" AND {_marks(line, BESIDE_NAVIGATION)} < 2 + length({line}) div {EVERY} AND {_marks(line, BESIDE_SHOUTING)} < 5 + 5 * (length({line}) div {EVERY}))"
    )


def _marks(line: str, beside: str) -> str:
    return f"length(regexp_replace({line}, r'{beside}', ''))"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value. Where the optimizer copies an expression, value is still computed once in it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str = "_lk_words") -> str:
    """SQL: words in windows of three words that occur twice or more."""
    # Windows are compared by the 64-bit hash of their three words, within one text only.
    windows = (
        "sort_array(CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3),"
        " i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)) ELSE array() END)"
    )
    # Places of the windows whose neighbour in that order is equal.
    twice = (
        "sort_array(filter(transform(s, (x, j) -> CASE WHEN (j > 0 AND s[j - 1].h = x.h)"
        " OR (j < size(s) - 1 AND s[j + 1].h = x.h) THEN x.i END), p -> p IS NOT NULL))"
    )
    covered = "aggregate(transform(t, (p, j) -> CASE WHEN j < size(t) - 1 THEN least(3, t[j + 1] - p) ELSE 3 END), 0L, (a, x) -> a + x)"
    return _let("w", words, _let("s", windows, _let("t", twice, covered)))


def _base(n_words: str, repeat_words: str, min_words: int, max_repeat: int) -> str:
    """SQL: does a document fail the base statistics?"""
    return f"({n_words} < {min_words} OR 100 * {repeat_words} > {max_repeat} * {n_words})"


def _enough(kept_chars: str, word_chars: str, min_kept: int) -> str:
    """SQL: is enough of a document left?"""
    return f"100 * {kept_chars} >= {min_kept} * {word_chars}"


def _steps(min_words: int, max_repeat: int, min_kept: int) -> list[dict[str, str]]:
    """SQL for the working columns; each dict is one projection that uses the one before."""
    return [
        {"_lk_lines": f"filter(split(coalesce(_lk_text, ''), r'\n'), l -> l rlike r'{HAS_WORD}')"},
        {
            "n_words": "CAST(size(_lk_words) AS BIGINT)",
            "word_chars": "CAST(length(array_join(_lk_words, '')) AS BIGINT)",
            "n_symbols": "CAST(length(regexp_replace(coalesce(_lk_text, ''), '[^#*$%&|<>]+', '')) AS BIGINT)",
            "n_dup_lines": "CAST(size(_lk_lines) - size(array_distinct(_lk_lines)) AS BIGINT)",
            "n_repeat_words": _repeat_words(),
            "_lk_kept_chars": _kept_chars("_lk_lines"),
        },
        {"base_failed": _base("n_words", "n_repeat_words", min_words, max_repeat)},
        {"kept": f"NOT base_failed AND {_enough('_lk_kept_chars', 'word_chars', min_kept)}"},
    ]


def _kept_chars(lines: str) -> str:
    """SQL: characters of words in the lines that pass."""
    return f"length(regexp_replace(array_join(filter({lines}, l -> {_passes('l')}), ''), r'{SPACE}', ''))"


def _kept(text: str, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT) -> str:
    """SQL: the verdict as one expression. As a filter it is moved next to the scan, so its words are bound in it."""
    words = f"array_remove(split(coalesce({text}, ''), r'{SPACE}'), '')"
    lines = f"split({text}, r'\\n')"
    enough = _enough(_kept_chars(lines), "length(array_join(v, ''))", min_kept_percent)
    verdict = f"size(v) >= {min_words} AND {enough} AND NOT {_base('size(v)', _repeat_words('v'), min_words, max_repeat_percent)}"
    return _let("v", words, f"({verdict})")


def judge(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """docs with the base statistics, base_failed and kept."""
    out = docs.withColumn("_lk_text", F.col(text)).withColumn("_lk_words", words_of(F.col("_lk_text")))
    for step in _steps(min_words, max_repeat_percent, min_kept_percent):
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """key, the statistics and the verdict of every row."""
    return judge(docs.select(F.col(key).alias("_lk_key"), F.col(text).alias("text")), "text", **rules).select(F.col("_lk_key").alias(key), *MEASURES)


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **rules) -> DataFrame:
    """The documents that are kept, without their failing lines; columns as in docs, n_chars counted anew."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_lk_c{i}") for i, c in enumerate(names)])
    at = names.index(text)
    out = inner.where(_kept(f"_lk_c{at}", **rules))
    lines = F.expr(f"filter(split(_lk_c{at}, r'\n'), l -> NOT l rlike r'{HAS_WORD}' OR {_passes('l')})")
    out = out.withColumn("_lk_new", F.array_join(lines, "\n"))
    new = {text: F.col("_lk_new"), n_chars: F.length("_lk_new").cast("long")}
    return out.select(*[new.get(c, F.col(f"_lk_c{i}")).alias(c) for i, c in enumerate(names)])
