"""Search as people type it: words, "phrases", or, -without; within tenants and domains; with fragments of the text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.retrieval import fused

# Letters with marks, and what they are compared as.
MARKED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
WORD = "[a-z0-9ß]+"
TENANTS = ("personal", "shared", "work")


# Portuguese endings and what is left of a word, applied one after the other: plurals, adverbs, verbs, the final vowel.
# The rules follow public descriptions of light stemming; words are in lower case and without marks by then.
ENDINGS = [
    (r"\b([a-z]{2,}?)oes\b", "ao"), (r"\b([a-z]+?)(?:aes|aos)\b", "ao"), (r"\b([a-z]{2,}?)ais\b", "al"), (r"\b([a-z]{2,}?)eis\b", "el"), (r"\b([a-z]{2,}?)ois\b", "ol"), (r"\b([a-z]{3,}?)is\b", "il"),
    (r"\b([a-z]{2,}?)ns\b", "m"), (r"\b([a-z]{2,}?[rzl])es\b", ""), (r"\b([a-z]{2,}?[a-rt-z])s\b", ""), (r"\b([a-z]{3,}?)a?mente\b", ""),
    (r"\b([a-z]{4,}?)(?:ando|endo|indo|ado|ido|ada|ida|aram|eram|iram|avam|ava|iam|ia|ou|eu|iu|ar|er|ir|am|em)\b", ""), (r"\b([a-z]{3,}?)[aeo]\b", ""),
]
#: The endings that each of these takes away, one list for each.
SHED = [w.split() for w in ("oes", "aes aos", "ais", "eis", "ois", "is", "ns", "es", "s", "mente amente", "ando endo indo ado ido ada ida aram eram iram avam ava iam ia ou eu iu ar er ir am em", "a e o")]
#: Letters at a word's start that no ending touches.
FIRM = 2


def stem_of(word: str) -> str:
    """What is left of a folded word."""
    for pattern, ending in ENDINGS:
        word = re.sub(pattern, r"\1" + ending, word)
    return word


def inflected(stem: str) -> list[str]:
    """Every folded word that has this stem: the endings are put back from the last to the first."""
    found = {stem}
    for (pattern, ending), shed in reversed(list(zip(ENDINGS, SHED, strict=True))):
        longer = {w[: len(w) - len(ending)] + e for w in found if w.endswith(ending) for e in shed}
        found = {w for w in found | longer if re.sub(pattern, r"\1" + ending, w) in found}
    return sorted(found)


def stemmed(words: Column) -> Column:
    """A folded text with each word's stem in its place."""
    out = F.replace(words, F.lit("ß"), F.lit("ss"))
    for pattern, ending in ENDINGS:
        out = F.regexp_replace(out, pattern, "$1" + ending)
    return out


def stems(alternatives: list[list[tuple[str, bool]]]) -> list[list[tuple[str, bool]]]:
    return [[(" ".join(map(stem_of, w.replace("ß", "ss").split())), yes) for w, yes in own] for own in alternatives]


def parsed(query: str) -> list[list[tuple[str, bool]]]:
    """Alternatives of (words, wanted): all of one alternative must hold; words of a phrase are joined by spaces."""
    out: list[list[tuple[str, bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        words = re.findall(WORD, (phrase or word.lstrip("-")).lower().translate(str.maketrans(MARKED, PLAIN)))
        if words:
            out[-1].append((" ".join(words), not (minus or (word.startswith("-") and not phrase))))
    return [a for a in out if a]


def folded(text: Column) -> Column:
    """A text's words, in lower case and without marks, each between spaces."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, "[^a-z0-9ß]+", " ")), F.lit(" "))


def lowered(text: Column) -> Column:
    """A text in lower case, null as empty: what `matches` and `occurrences` read. A folded text does as well."""
    return F.lower(F.coalesce(text, F.lit("")))


LETTERS = f"a-z0-9ß{MARKED}"
BETWEEN = f"[^{LETTERS}]+"


def _letter(c: str) -> str:
    return f"[{c}{''.join(m for m, p in zip(MARKED, PLAIN, strict=True) if p == c)}]" if c in PLAIN else c


def _pattern(phrase: str) -> str:
    """A folded word or phrase as it may stand in lower case, with marks. Its first letter is tried first."""
    first, *words = _letter(phrase[0]), *("".join(map(_letter, w)) for w in phrase.split())
    words[0] = words[0].removeprefix(first)
    return f"{first}(?<![{LETTERS}]{first}){BETWEEN.join(words)}(?![{LETTERS}])"


def _begins(letters: str) -> str:
    """The first letters of a word whose ß count as ss."""
    return f"(?<![{LETTERS}])" + ("(?:ss|ß)" if letters == "ss" else "".join("[sß]" if c == "s" else _letter(c) for c in letters))


def bound(value: Column, use) -> Column:
    """use of a value that is computed once, however often it is named: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def matches(text: Column, alternatives: list[list[tuple[str, bool]]]) -> Column:
    """Does a text in lower case satisfy one of the alternatives? A query without words finds nothing."""
    one = lambda w, wanted: text.rlike(_pattern(w)) if wanted else ~text.rlike(_pattern(w))
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [one(*x) for x in own]) for own in alternatives], F.lit(False))


def occurrences(text: Column, alternatives: list[list[tuple[str, bool]]]) -> Column:
    """How often wanted words and phrases occur in a text in lower case, a simple rank; each counts from where the last
    one of its kind ended."""
    wanted = list(dict.fromkeys(w for own in alternatives for w, yes in own if yes))
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(_pattern(w))) for w in wanted], F.lit(0)).cast("long")


def _first(docs: DataFrame, score: Column, k: int) -> DataFrame:
    """id and score of the k best rows by a score that is null for others; as these come last and leave after the limit,
    no filter repeats the score's work."""
    return docs.select("id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(k).where("score IS NOT NULL")


def websearch(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """id and score of the k documents (id, text) that a query finds best, ties by id. Rows are judged where they stand,
    each text is put in lower case once and never rewritten; only each task's best move."""
    alternatives = parsed(query)
    return _first(docs, bound(lowered(F.col("text")), lambda t: F.when(matches(t, alternatives), occurrences(t, alternatives))), k)


def cover_rank(words: Column, alternatives: list[list[tuple[str, bool]]]) -> Column:
    """The cover density of a folded text: the sum, over its minimal covers, of 0.1 / (1 + words between that aren't
    asked for).

    A cover is a stretch that has all wanted words and phrases of one alternative and holds no shorter one. Words that
    are asked for are walked in order with the place of the last occurrence of each item; the latest start of a stretch
    that is complete moves on exactly where a new minimal cover ends."""
    return _covers(F.split(F.trim(words), " "), alternatives)


def _covers(tokens: Column, alternatives: list[list[tuple[str, bool]]]) -> Column:
    """`cover_rank` of a text's words."""
    items = [[x for x, yes in own if yes] for own in alternatives]
    items = [own for own in items if own]
    if not items:
        return F.lit(0.0)
    known = list(dict.fromkeys(x for own in items for x in own))
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(w for x in known for w in x.split())])
    of = lambda x: [F.array_position(asked, F.lit(w)) for w in x.split()]
    places = F.filter(F.transform(tokens, lambda w, i: F.struct(i.alias("at"), F.array_position(asked, w).alias("w"))), lambda x: x["w"] > 0)

    def starts(hits: Column) -> Column:
        """For each place, where in the list the items start that end there; -1 for others."""

        def start(x: str, h: Column) -> Column:
            words, own = of(x), lambda j: F.get(hits, h - j)
            fits = reduce(lambda a, b: a & b, [(own(j)["w"] == words[-1 - j]) & (own(j)["at"] == own(0)["at"] - j) for j in range(len(words))])
            return F.when(F.coalesce(fits, F.lit(False)), h - (len(words) - 1)).otherwise(-1)

        return F.transform(hits, lambda x, h: F.struct(h.alias("h"), F.array(*[start(w, h) for w in known]).alias("starts")))

    def density(hits: Column) -> Column:
        many = lambda f, columns: columns[0] if len(columns) == 1 else f(*columns)
        begin = lambda last: many(F.greatest, [many(F.least, [F.get(last, known.index(x)) for x in own]) for own in items])
        zero = F.struct(F.array_repeat(F.lit(-1), len(known)).alias("last"), F.lit(-1).alias("left"), F.lit(0.0).alias("sum"))

        def step(a: Column, x: Column) -> Column:
            moved = F.zip_with(a["last"], x["starts"], lambda p, q: F.greatest(p, q))
            # A one-element array binds the new start, which is used four times.
            return F.get(F.transform(F.array(F.struct(moved.alias("last"), begin(moved).alias("left"))), lambda n: F.struct(
                n["last"].alias("last"), F.greatest(a["left"], n["left"]).alias("left"),
                (a["sum"] + F.when(n["left"] > a["left"], 0.1 / (1 + F.get(hits, x["h"])["at"] - F.get(hits, n["left"])["at"] - x["h"] + n["left"])).otherwise(0.0)).alias("sum"),
            )), 0)

        return F.aggregate(starts(hits), zero, step, lambda a: a["sum"])

    return F.get(F.transform(F.array(places), density), 0)


def ranked(docs: DataFrame, query: str, k: int = 10, stemming: bool = False) -> DataFrame:
    """id and score (cover density) of the k documents (id, text) that a query finds best, ties by id; with stemming,
    words meet by their Portuguese stems.

    Rows are judged where they stand and only each task's best move. Texts are split into words once, and only those
    that hold what the query wants: without stemming its words, with stemming the firm first letters of the words of one
    alternative. No text is stemmed: the words that have a wanted stem are listed first, and looked up."""
    alternatives = parsed(query)
    plain = lambda w: F.when(F.octet_length(w) > F.length(w), F.replace(F.translate(w, MARKED, PLAIN), F.lit("ß"), F.lit("ss" if stemming else "ß"))).otherwise(w)
    words = lambda t: F.transform(F.split(t, BETWEEN), plain)
    if not stemming:
        covers = lambda t: F.when(matches(t, alternatives), bound(words(t), lambda ws: F.round(_covers(ws, alternatives), 6)))
        return _first(docs, bound(lowered(F.col("text")), covers), k)
    firm = [list(dict.fromkeys(w[:FIRM] for x, yes in own if yes for w in x.replace("ß", "ss").split())) for own in alternatives]
    starts = lambda t, own: reduce(lambda a, b: a & b, [t.rlike(_begins(w)) for w in own], F.lit(True))
    some = lambda t: reduce(lambda a, b: a | b, [starts(t, own) for own in firm], F.lit(False))
    alternatives = stems(alternatives)
    known = list(dict.fromkeys(w for own in alternatives for x, _ in own for w in x.split()))
    forms, other = {x: inflected(x) for x in known}, "0" * (max(map(len, known), default=0) + 1)
    stem = lambda w: F.when(w.isin([f for own in forms.values() for f in own]), F.coalesce(*[F.when(w.isin(own), x) for x, own in forms.items()], F.lit(other))).otherwise(other)
    held = lambda ws: matches(F.array_join(ws, " "), alternatives)
    covers = lambda ws: F.when(held(ws), F.round(_covers(ws, alternatives), 6))
    return _first(docs, bound(lowered(F.col("text")), lambda t: F.when(some(t), bound(F.transform(words(t), stem), covers))), k)


def headline(text: Column, query: str, before: int = 5, size: int = 15, most: int = 2) -> Column:
    """Up to `most` fragments of a text, `size` words each, around the first words that the query wants, which stand
    between « and »; fragments are joined by " … ". A text without any is its first words."""
    wanted = sorted({w for own in parsed(query) for x, yes in own if yes for w in x.split()})
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hit = lambda w: F.regexp_replace(F.translate(F.lower(w), MARKED, PLAIN), "[^a-z0-9ß]+", "").isin(wanted)
    marked = F.transform(words, lambda w: F.when(hit(w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    places = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    starts = F.aggregate(  # a fragment for each place that the last one doesn't reach
        places, F.array().cast("array<int>"),
        lambda a, i: F.when((F.size(a) == 0) | ((F.size(a) < most) & (i >= F.element_at(a, -1) + size)), F.concat(a, F.array(F.greatest(i - before, F.lit(0)).cast("int")))).otherwise(a),
    )
    shown = F.when(F.size(starts) > 0, starts).otherwise(F.array(F.lit(0)))
    return F.array_join(F.transform(shown, lambda s: F.array_join(F.slice(marked, s + 1, F.lit(size)), " ")), " … ")


def tenant_scope(tenant: str, include_shared: bool = False, allowed: tuple[str, ...] = TENANTS) -> list[str]:
    """The tenants that a search may see; an unknown one is an error."""
    if tenant not in allowed:
        raise ValueError(f"unknown tenant {tenant!r}")
    return [tenant, "shared"] if include_shared and tenant != "shared" and "shared" in allowed else [tenant]


def scoped(docs: DataFrame, tenants: list[str], domain: str | None = None, domain_strict: bool = True) -> DataFrame:
    """Active rows of some tenants, and of a domain where one is given; rows without domain too where that isn't strict."""
    inside = F.col("tenant").isin(tenants) & (F.col("status") == "active")
    if domain is not None:
        inside = inside & ((F.col("domain") == domain) if domain_strict else F.col("domain").isNull() | (F.col("domain") == domain))
    return docs.where(inside)


def guard(rows: DataFrame, tenant: str, vault: str = "tenant") -> DataFrame:
    """rows, all of which belong to a tenant; an error names up to three that don't."""
    wrong = [r[0] for r in rows.where(~F.col(vault).eqNullSafe(tenant)).select(F.col(vault).cast("string")).distinct().limit(3).collect()]
    if wrong:
        raise PermissionError(f"rows of {', '.join(map(str, wrong))} where only {tenant} may be")
    return rows


def hybrid(docs: DataFrame, query: str, vector_places: DataFrame | None, k: int, details: list[str]) -> DataFrame:
    """The k best documents by fused places of both searches, with details, a snippet and both places, in fused order.

    vector_places (id, place) may be None: then it is text search alone. Ids that docs doesn't have are left out.
    """
    found = websearch(docs, query, k * 4)
    text = found.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("place"))  # 4 k rows
    lists = text.select(F.lit(1).alias("list"), "place", "id")
    if vector_places is not None:
        lists = lists.unionByName(vector_places.select(F.lit(0).alias("list"), "place", "id"))
    first = lists.groupBy("id").agg(F.min(F.struct("list", "place")).alias("_first"))
    best = fused(lists).limit(k).join(first, "id")
    out = docs.select("id", *details, headline(F.col("text"), query).alias("snippet")).join(F.broadcast(best), "id")  # k rows
    out = out.join(text.select("id", F.col("place").cast("long").alias("text_place")), "id", "left")
    if vector_places is not None:
        out = out.join(vector_places.select("id", F.col("place").cast("long").alias("vector_place")), "id", "left")
    return out.orderBy(F.desc("score"), "_first").drop("_first")
