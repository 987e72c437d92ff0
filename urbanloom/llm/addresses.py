"""Addresses of one place, written differently.

Each row is read into components wherever they stand (street words, kind of street, house number, unit letter, postcode,
locality). A block is a city: the postcodes that share a locality, so that a street meets those of neighbouring postcodes; a
row whose postcode and town contradict each other lies in both blocks. Inside a block the words of the distinct street names
are indexed by their forms with at most two letters deleted; names that share a form of a word are candidates, and an
optimal assignment of their components decides: words to words in any order at the least sum of edits, while another
number, letter, kind of street or count of words is a veto. Each name points to the commonest name that it is a variant of.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.session import cut, partitions

#: Kinds of street and their short forms, by where they stand in a name.
KINDS_LAST = {
    "street": ["street", "st", "strasse", "str"], "weg": ["weg", "wg"], "platz": ["platz", "pl"], "allee": ["allee"], "gasse": ["gasse"], "ring": ["ring"], "damm": ["damm"], "ufer": ["ufer"],
    "road": ["road", "rd"], "avenue": ["avenu", "avenue", "ave", "av"], "lane": ["lane", "ln"], "court": ["court", "ct"], "drive": ["drive", "dr"],
    "square": ["square", "sq"], "close": ["close"], "terrace": ["terrace", "ter"], "place": ["place"],
}
KINDS_FIRST = {
    "rue": ["ru", "rue", "r"], "avenue": ["avenu", "avenue", "ave", "av"], "chemin": ["chemin", "chem", "ch"], "place": ["place", "pl"], "boulevard": ["boulevard", "bd", "boul", "blvd"],
    "impasse": ["impasse", "imp"], "allee": ["allee", "all"], "quai": ["quai"], "route": ["route", "rte"],
}
#: Kinds of street that German joins to the word before.
SUFFIXES = ["strasse", "platz", "allee", "gasse", "weg", "ring", "damm", "ufer", "str", "pl", "wg"]

#: Letters below which a name allows one edit instead of two.
SHORT_NAME = 8
#: Letters of a word from which its parts are indexed instead of its deletions (the same words match), and forms handed over at once.
LONG_WORD, FORMS_AT_ONCE = 32, 50_000
#: Rows of a place that meet all others of it in one task; larger places are dealt out.
DEALT_ROWS = 2_000

_LAST = {form: kind for kind, forms in KINDS_LAST.items() for form in forms}
_FIRST = {form: kind for kind, forms in KINDS_FIRST.items() for form in forms}
_NUMBER = r"(?:n[ro°º]?\.?\s*°?\s*)?(?P<n>\d{1,5})\s*[-/]?\s*(?P<u>[a-z])?"
_LEADING = re.compile(rf"^\s*{_NUMBER}(?![a-z0-9])[\s,]+(?=\S)")
_TRAILING = re.compile(rf"[\s,]+{_NUMBER}\s*$")
_ALONE = re.compile(rf"^\s*{_NUMBER}\s*$")
_ZIP = re.compile(r"^\s*(?:[a-z]{1,2}[\s-]+)?(?P<z>\d[\d ]*)(?=\s|$)")
_SPLIT = re.compile(r"\s*[,;]\s+|\s+[-–]\s+")


def _flat(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def _short(text: str) -> str:
    return text.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def fold(text: str) -> str:
    """Lower case without accents, with ``ae``, ``oe``, ``ue`` as the vowel alone and sharp s as ``ss``."""
    return _short(_flat(text))


def spell(text: str) -> str:
    """Lower case without accents, with umlauts written out as ``ae``, ``oe``, ``ue`` and sharp s as ``ss``."""
    composed = unicodedata.normalize("NFC", text.casefold())
    return _flat(composed.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue"))


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with swaps of neighbours; ``most + 1`` if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    older, old = {}, {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):  # only the band of cells that can stay within ``most``
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[0] = i
                continue
            d = min(old.get(j, far) + 1, new.get(j - 1, far) + 1, old.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values(), default=far) > most:
            return far
        older, old = old, new
    return min(old.get(len(b), far), far)


def word_cost(a: list[str], b: list[str], most: int = 2) -> int:
    """Least sum of edits over all assignments of the words of ``a`` to those of ``b``; ``most + 1`` if their counts differ.

    Equal words go to each other; as each further word costs an edit at least, no more than ``most`` are left to assign.
    """
    left, right = Counter(a) - Counter(b), Counter(b) - Counter(a)
    if len(a) != len(b) or left.total() > most:
        return most + 1
    rest = list(right.elements())
    return min([most + 1, *(sum(osa(x, y, most) for x, y in zip(left.elements(), p, strict=True)) for p in permutations(rest))])


def _near(word: str, forms: dict[str, str]) -> str | None:
    hits = {kind for form, kind in forms.items() if len(form) >= 4 and osa(word, form, 1) <= 1}
    return hits.pop() if len(hits) == 1 else None


def read_street(text: str) -> tuple[list[str], str]:
    """(words without the kind of street, kind) of a folded street name; kind '' if none is seen."""
    words = re.findall(r"[^\W\d_]+", text)
    if not words:
        return [], ""
    if len(words) > 1:
        if words[0] in _FIRST and not (words[-1] in _LAST and len(words[0]) > 2):
            return words[1:], _FIRST[words[0]]
        if words[-1] in _LAST:
            return words[:-1], _LAST[words[-1]]
    for suffix in SUFFIXES:
        if words[-1].endswith(suffix) and len(words[-1]) - len(suffix) >= 3:
            return [*words[:-1], words[-1][: -len(suffix)]], _LAST[suffix]
    if len(words) > 1:
        if kind := _near(words[-1], _LAST):
            return words[:-1], kind
        if kind := _near(words[0], _FIRST):
            return words[1:], kind
        if osa(words[0], "ru", 1) <= 1 and len(words[0]) <= 3:
            return words[1:], "rue"
        if osa(words[-1], "weg", 1) <= 1:
            return words[:-1], "weg"
    tail = words[-1]
    best = min(((osa(tail[-n:], s, 1), -len(s), n, s) for s in ("strasse", "platz", "allee", "gasse", "weg") for n in range(len(s) - 1, len(s) + 2) if len(tail) - n >= 4), default=(2, 0, 0, ""))
    if best[0] <= 1:
        return [*words[:-1], tail[: -best[2]]], best[3]
    return words, ""


def _place(text: str) -> tuple[str, str]:
    """(postcode of five digits or '', locality) of a folded text that may hold both."""
    m = _ZIP.match(text)
    code = ""
    if m and 1 <= len(digits := m["z"].replace(" ", "")) <= 5:
        code, text = digits.zfill(5), text[m.end() :]
    text = re.split(r"\(|/|\bot\b|,", text)[0]
    return code, " ".join(w for w in re.findall(r"[^\W\d_]+", text) if len(w) > 2)


def _number(text: str | None) -> tuple[str, str] | None:
    m = _ALONE.match(text) if text else None
    return (str(int(m["n"])), m["u"] or "") if m else None


def read_address(street: str | None, house_number: str | None, zip_code: str | None, city: str | None, form=fold):
    """(words, kind, number, letter, postcode, locality) or None if no house number is seen. Fields may be in each other's place."""
    street, house_number, zip_code, city = (form(x).strip() if x and x.strip() else "" for x in (street, house_number, zip_code, city))
    code_a, town_a = _place(zip_code) if zip_code else ("", "")
    code_b, town_b = _place(city) if city else ("", "")
    code, town = code_a or code_b, town_b or town_a
    number = _number(house_number)
    if not street and house_number and number is None:
        street = house_number  # the street stands in the field of the number
    parts = [p for p in _SPLIT.split(street) if p.strip()] if street else []
    if len(parts) > 1:
        # some part may be the number alone, another the postcode and locality
        carried = any(_TRAILING.search(p) or _LEADING.match(p) for p in parts)
        rest = []
        for part in parts:
            if number is None and not carried and _number(part):
                number = _number(part)
            else:
                rest.append(part)
        if len(rest) > 1 and not (code or town):
            towns = [i for i, p in enumerate(rest) if (m := _ZIP.match(p)) and (len(m["z"].replace(" ", "")) >= 4 or m.end() == len(p.rstrip()))]
            plain = [i for i, p in enumerate(rest) if not re.search(r"\d", p)]
            numbered = [i for i, p in enumerate(rest) if _TRAILING.search(p) or _LEADING.match(p)]
            i = towns[0] if towns else plain[-1] if plain and len(plain) < len(rest) else next((i for i in range(len(rest)) if i not in numbered[-1:]), 0)
            if not towns and not plain and len(numbered) > 1:  # "7 locality, street 11": the postcode has lost its zeros
                kinds = [i for i in numbered if read_street(_TRAILING.sub("", rest[i]))[1]]
                i = next((i for i in numbered if i not in kinds), numbered[0])
            code, town = _place(rest.pop(i))
        street = " ".join(rest)
    if number is None and street:
        m = _TRAILING.search(street) or _LEADING.match(street)
        if m:
            number = str(int(m["n"])), m["u"] or ""
            street = street[: m.start()] + " " + street[m.end() :]
    words, kind = read_street(street)
    if number is None or not words or not (code or town):
        return None
    return words, kind, *number, code, town


def spellings(fields: list[str | None], found: tuple) -> tuple[str | None, str | None]:
    """Street name and locality of an address that was read, with ``ae``, ``oe``, ``ue`` written out; null if that changes nothing."""
    if not any(x and fold(x) != spell(x) for x in fields):
        return None, None
    other = read_address(*fields, spell)
    if other is None:
        return None, None
    pairs = (" ".join(found[0]), " ".join(other[0])), (found[-1], other[-1])
    return tuple(y if x != y and _short(y) == x else None for x, y in pairs)


_READ = "id long, words array<string>, kind string, number string, letter string, code string, town string, spelt string, spelt_town string"


def read_addresses(df: DataFrame, key: str = "id") -> DataFrame:
    """Components of each row with a house number, a street, and a postcode or locality; other rows denote no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row_id, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = read_address(*fields)
                if found and row_id is not None:
                    out.append((row_id, *found, *spellings(fields, found)))
            if out:
                kinds = [pa.int64(), pa.list_(pa.string()), *[pa.string()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return df.select(F.col(key).cast("long").alias("id"), "street", "house_number", "zip_code", "city").mapInArrow(run, _READ)


def _deleted(word: str, most: int) -> set[str]:
    """``word`` and its forms with at most ``most`` letters deleted."""
    last = out = {word}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(length * k // parts, length * (k + 1) // parts) for k in range(parts)]


def own_forms(word: str, most: int) -> set[str]:
    """Forms of a word of which any word within ``most`` edits has one among its ``other_forms``.

    Short words: letters deleted (an edit costs each of two words one letter at most). Long words: 2 * most + 1 parts, of
    which an edit touches two at most.
    """
    if len(word) <= LONG_WORD:
        return _deleted(word, most)
    return {f"{len(word)}#{k}#{word[a:b]}" for k, (a, b) in enumerate(_cuts(len(word), 2 * most + 1))}


def other_forms(word: str, most: int) -> set[str]:
    """See ``own_forms``: a part stands at most ``most`` letters further left or right in the other word."""
    out = _deleted(word, most) if len(word) <= LONG_WORD + most else set()
    for n in range(max(LONG_WORD + 1, len(word) - most), len(word) + most + 1):
        out |= {f"{n}#{k}#{word[a + d : b + d]}" for k, (a, b) in enumerate(_cuts(n, 2 * most + 1)) for d in range(-most, most + 1) if a + d >= 0}
    return out


def name_forms(name: str, most: int, own: bool) -> set[str]:
    """Tokens of ``name`` by their forms, with the number of its words: those of its longest word (``own``) or of all words.

    The longest word of a name is assigned to some word of each name that is accepted for it, so both share a form.
    """
    words = name.split(" ")
    parts = own_forms(max(words, key=lambda w: (len(w), w)), most) if own else set().union(*(other_forms(w, most) for w in set(words)))
    return {f"{len(words)}|{x}" for x in parts}


def _token_index(names: DataFrame, block: list[str], most: int, own: bool) -> DataFrame:
    """(block..., name, n, borne, form): the forms, hashed, of the names' words; see ``name_forms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, forms = [], []

            def close(batch=batch) -> pa.RecordBatch:
                kept = batch.drop_columns(["spelt"]).take(pa.array(of, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.array(forms, np.uint64).view(np.int64))], names=[*kept.schema.names, "form"])

            for k, (name, spelt) in enumerate(zip(batch.column("name").to_pylist(), batch.column("spelt").to_pylist(), strict=True)):
                got = [xxhash.xxh3_64_intdigest(x) for x in set().union(*(name_forms(x, most if len(name) >= SHORT_NAME else 1, own) for x in {name, *spelt}))]
                of += [k] * len(got)
                forms += got
                if len(of) >= FORMS_AT_ONCE:
                    yield close()
                    of.clear()
                    forms.clear()
            if of:
                yield close()

    schema = ", ".join(f"`{c}` string" for c in [*block, "name"]) + ", n long, borne long, form long"
    return names.select(*block, "name", "n", "borne", "spelt").mapInArrow(run, schema)


def name_cost(a: str, b: str, spelt_a: list[str], spelt_b: list[str], most: int) -> int:
    """Least ``word_cost`` over the spellings of two names."""
    return min(word_cost(x.split(" "), y.split(" "), most) for x in {a, *spelt_a} for y in {b, *spelt_b})


def _decide(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(c).to_pylist() for c in ("name", "other", "spelt", "other_spelt"))
            cost = [name_cost(*x, most) for x in zip(a, b, sa, sb, strict=True)]
            keep = [c <= (most if min(len(x), len(y)) >= SHORT_NAME else 1) for c, x, y in zip(cost, a, b, strict=True)]
            out = batch.set_column(batch.schema.get_field_index("cost"), "cost", pa.array(cost, pa.int32())).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return run


def same_names(names: DataFrame, block: list[str], ratio: int = 2, most: int = 2) -> DataFrame:
    """(block..., name, hub): the name that each of the distinct ``names`` (block..., name, n, borne, spelt) is a variant of.

    n: rows of the name; borne: how much of its own it has to show for itself; ``spelt``: its other spellings. Names are matched inside a block if their words, in any order, or those of
    their spellings, can be assigned with at most ``most`` edits (one for names of fewer than SHORT_NAME letters). Of two
    matching names the rarer one, by n and then by the alphabet, is the variant, and of the nearest matches the commonest is
    its hub. A name that is borne out by more than two isn't a variant unless the other is borne out by ``ratio`` times as
    many, nor does it follow its hub to a name that it doesn't match itself.
    """
    # a few rows may have many forms: they are dealt over all tasks first
    names = cut(names.repartition(partitions(names.sparkSession), *block, "name"))
    own, others = _token_index(names, block, most, True), _token_index(names, block, most, False)
    others = others.select(*block, F.col("name").alias("other"), F.col("n").alias("m"), F.col("borne").alias("other_borne"), "form")
    variant = (F.col("borne") <= 2) | (F.col("other_borne") >= ratio * F.col("borne"))
    commoner = F.struct("m", "other") > F.struct("n", "name")
    pairs = own.join(others, [*block, "form"]).filter(commoner & variant).select(*block, "name", "other", "borne", "m").distinct()
    spelt = names.filter(F.size("spelt") > 0)
    for name, column in (("name", "spelt"), ("other", "other_spelt")):
        pairs = pairs.join(spelt.select(*block, F.col("name").alias(name), F.col("spelt").alias(column)), [*block, name], "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    judged = pairs.select(*block, "name", "other", "borne", "m", "spelt", "other_spelt", F.lit(0).alias("cost"))
    accepted = cut(judged.mapInArrow(_decide(most), judged.schema))
    nearest = cut(accepted.groupBy(*block, "name").agg(F.max_by("other", F.struct(-F.col("cost"), "m", "other")).alias("hub"), F.max("borne").alias("borne")))
    further = nearest.filter("borne > 2").join(nearest.select(*block, F.col("name").alias("hub"), F.col("hub").alias("other")), [*block, "hub"])
    alone = further.join(accepted.select(*block, "name", "other"), [*block, "name", "other"], "left_anti").select(*block, "name")
    chosen = nearest.drop("borne").join(alone, [*block, "name"], "left_anti")
    hubs = cut(names.join(chosen, [*block, "name"], "left").select(*block, "name", F.coalesce("hub", "name").alias("hub")))
    while True:  # pointer doubling; every step leads to a commoner name
        step = hubs.join(hubs.select(*block, F.col("name").alias("hub"), F.col("hub").alias("top")), [*block, "hub"]).select(*block, "name", F.col("top").alias("hub"), (F.col("top") != F.col("hub")).alias("moved"))
        hubs = cut(step)
        if hubs.filter("moved").isEmpty():
            return hubs.drop("moved")


def _homes(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, of_code): the commonest locality of each postcode; (locality, home): the locality that most rows of each speak for.

    A row speaks for its postcode's locality, or for its own if it has no postcode, which yields in a tie: a city is its own home, while a town
    misspelt beyond recognition has the city of its postcodes as home.
    """
    size = named.filter(F.col("locality").isNotNull()).groupBy("locality").agg(F.count("*").alias("size"))
    coded = named.filter((F.col("code") != "") & F.col("locality").isNotNull()).groupBy("code", "locality").agg(F.count("*").alias("n")).join(size, "locality")
    of_code = cut(coded.groupBy("code").agg(F.max_by("locality", F.struct("n", "size", "locality")).alias("of_code")))
    votes = named.filter(F.col("locality").isNotNull()).join(of_code, "code", "left").groupBy("locality", F.coalesce("of_code", "locality").alias("home")).agg(F.count("*").alias("n"))
    homes = votes.groupBy("locality").agg(F.max_by("home", F.struct("n", F.col("home") != F.col("locality"), "home")).alias("home"))
    return of_code, cut(homes)


def places(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, place) of each row that denotes a place: place is a text that rows of one place share.

    Rows without house number, street, or any locality denote none. Null, empty and blank fields count as missing; an
    address that is repeated word for word is the same place. A row's locality is its name if that is a city, that is if
    most of its rows bear it out by their postcodes, else the commonest name of its postcode; a postcode that comes with no
    name stands for itself. Where a city contradicts the postcode, the postcode's counts if only that has the street.
    """
    read = cut(read_addresses(df, key))
    towns = read.filter("town <> ''").groupBy(F.col("town").alias("name")).agg(F.count("*").alias("n"), F.count("*").alias("borne"), F.collect_set("spelt_town").alias("spelt"))
    town_hubs = cut(same_names(towns, [], ratio=5).select(F.col("name").alias("town"), F.col("hub").alias("locality")))
    named = cut(read.join(town_hubs, "town", "left"))
    of_code, homes = _homes(named)
    home_of_code = of_code.join(homes.withColumnRenamed("locality", "of_code"), "of_code", "left").select("code", F.coalesce("home", "of_code").alias("of_code"))
    known = named.join(home_of_code, "code", "left").join(homes, "locality", "left")
    # a town that isn't a city of its own yields to the postcode; a city that contradicts its postcode is tried in both
    first = F.when(F.col("home") == F.col("locality"), F.col("home")).otherwise(F.coalesce("of_code", "home", F.concat(F.lit("#"), "code")))
    both = F.when(F.col("of_code") != first, F.array(first, "of_code")).otherwise(F.array(first))
    located = cut(known.select("id", F.array_join("words", " ").alias("name"), "spelt", "kind", "number", "letter", both.alias("localities")))
    tried = located.select("*", F.explode("localities").alias("locality"), (F.size("localities") == 1).alias("sure"))
    # a street is borne out by its house numbers: a misspelt row that was copied has one, a street of its own has several
    numbers = F.count_distinct(F.when(F.col("sure"), F.struct("number", "letter")))
    streets = tried.groupBy("locality", "kind", "name").agg(F.count_if("sure").alias("n"), numbers.alias("borne"), F.collect_set("spelt").alias("spelt"))
    hubs = same_names(streets, ["locality", "kind"])
    placed = tried.join(hubs, ["locality", "kind", "name"])
    place = F.concat_ws("|", "locality", "kind", "hub", "number", "letter").alias("place")
    there = placed.filter("sure").select("locality", "kind", "hub").distinct().withColumn("there", F.lit(True))
    torn = placed.filter("not sure").join(there, ["locality", "kind", "hub"], "left").withColumn("order", F.struct(F.col("there").isNotNull(), F.col("locality") == F.col("localities")[0]))
    chosen = torn.groupBy("id", "kind", "name", "number", "letter", "localities").agg(F.max_by(F.struct("locality", "hub"), "order").alias("best"))
    return placed.filter("sure").select("id", place).unionAll(chosen.select("id", "kind", "number", "letter", "best.*").select("id", place))


def same_place_pairs(df: DataFrame, key: str = "id") -> DataFrame:
    """Pairs (address_id_1, address_id_2), smaller id first, of rows that denote the same place, each once.

    Built from the membership of ``places``. The rows of a large place are dealt over several tasks, each of which holds them
    against all rows of the place.
    """
    found = cut(places(df, key).distinct())
    sizes = found.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").withColumn("slots", F.ceil(F.col("n") / DEALT_ROWS).cast("int"))
    members = found.join(sizes, "place")
    dealt = members.select("id", "place", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot"))
    every = members.select(F.col("id").alias("other"), "place", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return dealt.join(every, ["place", "slot"]).filter("id < other").select(F.col("id").alias("address_id_1"), F.col("other").alias("address_id_2"))
