"""Variant spellings of the names of people and groups.

Every spelling is rewritten by rules for titles, suffixes, token order, nicknames, initials, cut
given names and the forms of group names. The rewritten forms are exploded and equi-joined: first
surnames with their one-letter deletions, which finds the form a misspelling stands for, then
given names and initials, which finds the people a spelling can stand for. A form that several
people share is worth less: a spelling joins a person only with a large enough share of the
mentions of all people it could stand for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.lookalikes import TO_LATIN, base_form
from evidentia.session import cut, widen

MIN_SHARE = 0.35  # of the mentions of the people whom a short form fits

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew", "babs": "barbara", "barb": "barbara", "becky": "rebecca",
    "bella": "isabella", "ben": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert",
    "cathy": "katherine catherine", "charlie": "charles", "chris": "christopher christine", "cindy": "cynthia", "dan": "daniel", "danny": "daniel",
    "dave": "david", "debbie": "deborah", "dick": "richard", "dora": "dorothea", "ed": "edward", "eddie": "edward", "ella": "helena gabriela", "fran": "francesca",
    "fred": "frederick", "fritz": "frederick", "gabi": "gabriela", "gabby": "gabriela", "greg": "gregory", "hans": "johannes", "harry": "harold henry", "inga": "ingrid",
    "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "christopher",
    "kolya": "nikolai", "larry": "lawrence lorenzo", "lenny": "leonard", "lena": "helena", "lisa": "elizabeth", "liz": "elizabeth", "maggie": "margaret", "matt": "matthew",
    "meg": "margaret", "mick": "michael", "mike": "michael", "nat": "nathaniel", "ned": "edward", "nell": "helena", "nick": "nicholas nikolai", "pat": "patricia patrick",
    "patty": "patricia", "peggy": "margaret", "pete": "peter", "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel",
    "sandy": "alexander", "sasha": "alexander", "steve": "stephen", "sue": "susanna", "susie": "susanna", "ted": "theodore edward", "theo": "theodore", "tim": "timothy",
    "tom": "thomas tomasz", "tomek": "tomasz", "tony": "anthony", "trish": "patricia", "vic": "victoria victor", "vicky": "victoria", "will": "william",
}
TITLES = frozenset("prof dr mr mrs ms sir dame professor doctor".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md".split())
PARTICLES = frozenset("de van von der den del della di da du la le ter ten zu af".split())
GROUP_KINDS = {"consortium": "consortium", "consort": "consortium", "collaboration": "collaboration", "collab": "collaboration", "group": "group", "grp": "group", "gp": "group", "team": "team", "network": "network", "initiative": "initiative", "committee": "committee"}
# Legal forms; those of two letters could be initials and are left out.
LEGAL = frozenset("gmbh mbh ltd limited inc incorporated corp corporation llc llp plc sarl srl pty company".split())
GROUP_MODES = {"study": "study", "stud": "study", "working": "working", "work": "working", "research": "research", "trial": "trial"}

_FORM = "spelling string, n bigint, given string, how string, middle string, surname string, order int"


_BLANKS = re.compile(r"\s+")
_TO_LATIN = str.maketrans(TO_LATIN)
_WORDS = re.compile(r"[a-z0-9'’-]+")
_GROUP = re.compile("|".join(sorted(GROUP_KINDS, key=len, reverse=True)))
_PARTS = re.compile(r"[^\s,]+")
_INITIAL = re.compile(r"(?:[a-z]\.?-?){1,3}")
_CAPITALS = re.compile(r"[A-Z]{2,3}")
_LETTER = re.compile(r"[^\W\d_]")
_GLUED = re.compile(r"((?:[A-Za-z]\.)+)([A-Za-z][\w'’-]+)")  # J.Keissushaw


def folded(name: str) -> str:
    """Plain letters: Latin look-alikes, no accents, ordinary blanks."""
    if name.isascii():
        return _BLANKS.sub(" ", name).strip()
    s = unicodedata.normalize("NFD", base_form(name).translate(_TO_LATIN))
    return _BLANKS.sub(" ", "".join(c for c in s if not unicodedata.combining(c))).strip()


def forms(spelling: str) -> list[tuple[str, str, str, str, int]]:
    """Rewritings of one spelling: (given, how, middle initials, surname, order).

    ``how`` is full, initial, cut (first letters and a dot) or group; ``order`` tells the token
    orders apart, 0 for a sure one.
    """
    s = folded(spelling)
    low = s.lower()
    words = _WORDS.findall(low) if _GROUP.search(low) else []
    kinds = [GROUP_KINDS[w] for w in words if w in GROUP_KINDS]
    if kinds:
        modes = [GROUP_MODES[w] for w in words if w in GROUP_MODES]
        rest = [w for w in words if w not in GROUP_KINDS and w not in GROUP_MODES and w not in ("the", "of", "for", "a", "an")]
        return [(" ".join(modes + kinds), "group", "", " ".join(rest), 0)] if rest else []
    plain = low.replace(",", " ").replace(".", "").split()
    if len(plain) > 1 and plain[-1] in LEGAL:
        # a firm is told by its name, whatever its legal form is called
        core = [w for w in plain if w not in LEGAL and w not in ("the", "and", "&", "co")]
        return [("company", "group", "", " ".join(core), 0)] if core else []
    if "," in low:
        last, _, first = low.partition(",")
        return [_person(_tokens(first), _tokens(last), 0, s)] if last.strip() and _tokens(first) else [("", "full", "", " ".join(_tokens(last)), 0)]
    tokens = _tokens(low)
    if not tokens:
        return []
    if len(tokens) == 1:
        return [("", "full", "", tokens[0].strip("."), 0)]
    lead = 0
    while lead < len(tokens) and _is_initial(tokens[lead]):
        lead += 1
    if lead:
        return [_person(tokens[:lead], tokens[lead:], 0, s)] if lead < len(tokens) else []
    # initials in capitals at the end: Surname FM
    raw = _tokens(s)
    tail = len(raw)
    while tail > 1 and (_is_initial(tokens[tail - 1]) or (_CAPITALS.fullmatch(raw[tail - 1]) and not s.isupper() and tail == len(raw))):
        tail -= 1
    if tail < len(raw):
        firsts = [c for t in tokens[tail:] for c in t.strip(".").replace(".", "")]
        return [_person(firsts, tokens[:tail], 0, s)]
    out = []
    parts = [i for i, t in enumerate(tokens) if t in PARTICLES]
    if parts:
        i = parts[0]
        j = i
        while j < len(tokens) and tokens[j] in PARTICLES:
            j += 1
        if i == 0 and j < len(tokens) - 1:
            return [_person(tokens[j + 1 :], tokens[: j + 1], 0, s)]
        if i:
            return [_person(tokens[:i], tokens[i:], 0, s)]
    middle = [i for i, t in enumerate(tokens) if i and _is_initial(t)]
    if middle:
        return [_person(tokens[: middle[-1] + 1], tokens[middle[-1] + 1 :], 0, s)] if middle[-1] + 1 < len(tokens) else []
    if tokens[0].endswith(".") and len(tokens[0]) > 2:
        return [_person(tokens[:1], tokens[1:], 0, s)]
    out.append(_person(tokens[:-1], tokens[-1:], 1, s))
    out.append(_person(tokens[1:], tokens[:1], 2, s))
    return out


@lru_cache(200_000)
def _is_initial(token: str) -> bool:
    return (len(token) == 1 or "." in token) and bool(_INITIAL.fullmatch(token))


@lru_cache(200_000)
def _parts_of(token: str) -> tuple[str, ...]:
    """A token, parted where initials are glued to a surname; nothing for suffixes and signs."""
    if token.strip(".").lower() in SUFFIXES or not _LETTER.search(token):
        return ()
    m = _GLUED.fullmatch(token) if "." in token else None
    return m.groups() if m else (token,)


def _tokens(text: str) -> list[str]:
    out: list[str] = []
    found = _PARTS.findall(text)
    for k, t in enumerate(found):
        title = t.strip(".").lower() in TITLES and (t.endswith(".") or k == 0 and len(found) > 1)
        if not title:
            out += _parts_of(t)
    return out


def _person(firsts: list[str], lasts: list[str], order: int, _: str) -> tuple[str, str, str, str, int]:
    surname = " ".join(t.strip(".") for t in lasts)
    letters: list[str] = []
    given, how = "", "initial"
    for k, t in enumerate(firsts):
        if _is_initial(t):
            letters += [c for c in t if c.isalpha()]
        elif k == 0:
            given, how = t.strip("."), "cut" if t.endswith(".") else "full"
        elif given:
            given += " " + t.strip(".")
    if not given:
        given, letters = (letters[0], letters[1:]) if letters else ("", [])
        how = "initial"
    return given, how, "".join(letters), surname, order


def _deletions(word: str) -> Column:
    return F.expr(f"array_distinct(concat(array({word}), transform(sequence(1, length({word})), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1)))))")


def parsed(names: DataFrame) -> DataFrame:
    """One row per rewriting of each distinct spelling; of two token orders the likelier one.

    A word is likelier a given name the more different spellings it occurs in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, n in zip(pdf["spelling"], pdf["n"], strict=True):
                for given, how, middle, surname, order in forms(s):
                    for formal in NICKNAMES.get(given, given).split() if how == "full" and given in NICKNAMES else [given]:
                        out.append((s, n, formal, how, middle, surname, order))
            yield pd.DataFrame(out, columns=["spelling", "n", "given", "how", "middle", "surname", "order"])

    rows = cut(widen(names).mapInPandas(run, _FORM))
    unsure = rows.where("order > 0")
    spread_of = rows.where("how = 'full' and given <> ''").groupBy(F.element_at(F.split("given", " "), 1).alias("word")).agg(F.count_distinct("surname").alias("partners"))
    rated = unsure.withColumn("word", F.element_at(F.split("given", " "), 1)).join(spread_of, "word", "left")
    w = Window.partitionBy("spelling").orderBy(F.desc("_top"), "order")
    top = F.max("partners").over(Window.partitionBy("spelling", "order"))
    chosen = rated.withColumn("_top", top).withColumn("_first", F.first("order").over(w)).where(F.col("order") == F.col("_first"))
    return rows.where("order = 0").unionByName(chosen.select(*rows.columns))


def with_surnames(rows: DataFrame) -> DataFrame:
    """``rows`` with ``family``: the surname that a misspelt one stands for.

    Surnames of the same initial that share a form (the surname, or it less one letter) and differ
    by one edit or a swap are one where one of them is mentioned at most half as often. Of surnames
    under four letters the whole given name must agree, and only a letter more or less counts.
    """
    keyed = rows.withColumn("i", F.when(F.col("how") == "group", F.col("given")).otherwise(F.substring("given", 1, 1)))
    short = (F.col("how") == "full") & (F.length("surname") <= 4) & (F.length("given") >= 3)
    long = keyed.where("length(surname) >= 4").select("i", "surname", "n")
    brief = keyed.where(short & (F.col("surname") != "")).select(F.concat(F.lit("="), "given").alias("i"), "surname", "n")
    seen = long.unionAll(brief).groupBy("i", "surname").agg(F.sum("n").alias("m"))
    exploded = seen.select("i", "surname", "m", F.explode(_deletions("surname")).alias("form"))
    other = exploded.select("i", "form", F.col("surname").alias("s2"), F.col("m").alias("m2"))
    swap = (F.length("surname") == F.length("s2")) & (F.array_sort(F.split("surname", "")) == F.array_sort(F.split("s2", "")))
    near = (F.levenshtein("surname", "s2") <= 1) | (swap & (F.levenshtein("surname", "s2") == 2))
    stronger = (F.col("m2") >= 2 * F.col("m")) | ((F.col("m") <= 3) & (F.struct("m2", "s2") > F.struct("m", "surname")))
    better = (
        exploded.join(other, ["i", "form"])
        .where((F.col("surname") != F.col("s2")) & stronger)
        .where(near & (~F.col("i").startswith("=") | (F.length("surname") != F.length("s2"))))
        .groupBy("i", "surname")
        .agg(F.max_by("s2", F.struct("m2", "s2")).alias("better"))
    )
    whole = better.where("i like '=%'").select(F.expr("substring(i, 2)").alias("given"), "surname", F.col("better").alias("as_whole"))
    both = keyed.join(better.where("i not like '=%'"), ["i", "surname"], "left").join(whole, ["given", "surname"], "left")
    return both.withColumn("family", F.coalesce("better", "as_whole", "surname")).drop("better", "as_whole")


def members(names: DataFrame) -> DataFrame:
    """(person, spelling): whom each spelling stands for; several people where it fits several."""
    rows = cut(with_surnames(parsed(names)))
    groups = rows.where("how = 'group'").select(F.concat_ws("|", F.lit("group"), "given", "family").alias("person"), "spelling")
    people = rows.where("how <> 'group'")
    full = people.where("how = 'full' and length(given) > 1")
    persons = full.groupBy("family", "given").agg(F.sum("n").alias("m"), F.collect_set(F.substring("middle", 1, 1)).alias("middles")).withColumn("middles", F.array_remove("middles", ""))
    sure = full.select(F.concat_ws("|", "family", "given").alias("person"), "spelling")
    short = people.where("how <> 'full' or length(given) <= 1")
    fits = short.alias("s").join(persons.withColumnRenamed("given", "formal").withColumn("i", F.substring("formal", 1, 1)), ["family", "i"])
    fits = fits.where((F.col("how") == "initial") | F.col("formal").startswith(F.regexp_replace("given", "-$", "")))
    own = F.substring("middle", 1, 1)
    agreed = F.when((own == "") | (F.size("middles") == 0), 1).when(F.array_contains("middles", own), 2).otherwise(0)
    w = Window.partitionBy("spelling")
    fits = fits.withColumn("agreed", agreed).withColumn("best", F.max("agreed").over(w)).where("agreed = best and agreed > 0")
    fits = fits.withColumn("share", F.col("m") / F.sum("m").over(w))
    joined = fits.where(F.col("share") >= MIN_SHARE).select(F.concat_ws("|", "family", "formal").alias("person"), "spelling")
    lone = short.join(joined.select("spelling").distinct(), "spelling", "left_anti").select(F.concat_ws("|", "family", "i", F.lit("?")).alias("person"), "spelling")
    return groups.unionByName(sure).unionByName(joined).unionByName(lone).distinct()


def pairs(names: DataFrame) -> DataFrame:
    """(spelling_a, spelling_b): spellings of one person or group, smaller first.

    ``names`` holds (spelling, n) with the number of mentions. Null and blank spellings stand for
    nobody; equal spellings are one; ties of mentions go to the later surname.
    """
    who = cut(members(names))
    a, b = who.withColumnRenamed("spelling", "spelling_a"), who.withColumnRenamed("spelling", "spelling_b")
    return a.join(b, "person").where("spelling_a < spelling_b").select("spelling_a", "spelling_b").distinct()


def mentioned(doc_authors: DataFrame, items: DataFrame) -> DataFrame:
    """(spelling, n) over an array column ``authors`` and a column ``item``."""
    one = doc_authors.select(F.explode("authors").alias("spelling")).unionByName(items.select(F.col("item").alias("spelling")))
    return one.where("trim(spelling) <> ''").groupBy("spelling").agg(F.count("*").alias("n"))
