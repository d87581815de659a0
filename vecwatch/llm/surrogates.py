"""Surrogates for personal data.

Entities are found by patterns, named by type and canonical form (so `+1 (555) 010-9999` and `15550109999` are one), and listed once each. Every listed entity gets a
keyed replacement of its type: digits for digits, letters for letters in the same case and script, octets that stay octets, a given name of the same gender and script, a family name of the script. A person listed with a title is
replaced in the same text also where the full or family name stands without one. Replacements
that meet each other or a real entity are drawn again until all differ, so distinct entities stay distinct and equal ones stay equal through the whole
corpus. Texts are then put together again from what stands between the entities. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, row_key, stored, unpacked, whole

KEY = "surrogate-key-1"
#: Titles before a person's name, in the scripts of the names.
TITLES = {"male": "Mr|Herr|Señor|Monsieur|[Гг]-н[ау]?|[Гг]осподин[ау]?|[Κκ]|[Κκ]ύριος|[Κκ]ύριο|[Κκ]ύριε|[Κκ]υρίου",
          "female": "Mrs|Ms|Frau|Señora|Madame|[Гг]-ж[аиеу]|[Гг]оспож[аиеу]|[Κκ]α|[Κκ]υρία|[Κκ]υρίας"}
#: Type and pattern, in order of precedence. Java's regular expressions. Each begins with a test that fails fast: an address is tried only where its run of
#: characters begins or the last match ended (\G), a secret or a name looks ahead before it looks behind.
PATTERNS = (
    ("email", r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++(?<!\.)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?=[0-9A-Fa-f]{32})(?<=[=:]\s?[\"'])[0-9A-Fa-f]{32,64}(?=[\"'])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("phone", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}(?!\d)"),
    ("phone", r"\(\d{2,5}\)[ -]?\d{2,4}[ -]?\d{3,4}(?!\d)"),
    ("card", r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)"),
    *[(kind, rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?:{titles})\.?\s)\p{{Lu}}\p{{Ll}}+(?:\s\p{{Lu}}\p{{Ll}}+)?") for kind, titles in TITLES.items()],
)
#: Given names by gender and script.
NAMES = {
    ("male", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul".split(),
    ("female", "latin"): "Alma Berta Clara Diana Elsa Frida Greta Hanna Ida Julia Klara Lena Maria Nora Olga Petra".split(),
    ("male", "cyrillic"): "Антон Борис Виктор Денис Егор Иван Кирилл Лев Марк Олег Павел Роман".split(),
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга".split(),
    ("male", "greek"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μιχάλης Νίκος".split(),
    ("female", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία".split(),
}
#: Syllables a surrogate's family name is made of, by script: many more names than entities in a batch of draws.
SYLLABLES = {"latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wi zu".split(),
             "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во зу".split(),
             "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το ζα ζε ζο".split()}
WHOLE = "|".join(f"(?:{p})" for _, p in PATTERNS)
LETTERS_OF = {"lower": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}


def kind_of(found: Column, before: Column) -> Column:
    """Type of a match. Names need the title before them, which the caller hands over; the other types match as a whole. Null: a name without a title."""
    out = F.when(F.regexp_like(found, F.lit(rf"^(?:{PATTERNS[0][1]})$")), "email").when(F.regexp_like(found, F.lit(r"^[0-9A-Fa-f]{32,64}$")), "secret")
    out = out.when(F.regexp_like(found, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$")), "ip").when(F.regexp_like(found, F.lit(r"^[+(]")), "phone").when(F.regexp_like(found, F.lit(r"^[\d -]+$")), "card")
    for kind, titles in TITLES.items():
        out = out.when(F.regexp_like(before, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{titles})\.?\s$")), kind)
    return out


def canonical(kind: Column, found: Column) -> Column:
    """What makes two mentions one entity: digits of numbers, lower case of addresses and secrets, single spaces and initial capitals in names."""
    return (F.when(kind.isin("phone", "card"), F.regexp_replace(found, r"\D", "")).when(kind.isin("email", "secret"), F.lower(found))
            .when(kind == "ip", found).otherwise(F.initcap(F.regexp_replace(found, r"\s+", " "))))


def _draw(*parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def _pick(choices: Column, draw: Column) -> Column:
    return F.element_at(choices, (draw % F.size(choices) + 1).cast("int"))


def _characters(text: Column, seed: Column, digits_only: bool = False) -> Column:
    """Digits for digits and letters for letters of the same case and script; everything else stays."""
    def swap(c: Column, i: Column) -> Column:
        n = _draw(seed, i.cast("string"))
        out = F.when(F.regexp_like(c, F.lit(r"\d")), F.substring(F.lit("0123456789"), (n % 10 + 1).cast("int"), F.lit(1)))
        if not digits_only:
            for script, test in (("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}"), ("lower", r"\p{L}")):
                own = F.substring(F.lit(LETTERS_OF[script]), (n % len(LETTERS_OF[script]) + 1).cast("int"), F.lit(1))
                out = out.when(F.regexp_like(c, F.lit(test)), F.when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.upper(own)).otherwise(own))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _script(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(name, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _syllables(name: Column, seed: Column) -> Column:
    """A made-up name in the script of a name."""
    out = F.lit(None).cast("string")
    for own, parts in SYLLABLES.items():
        out = F.when(_script(name) == own, F.concat(*[_pick(F.array(*[F.lit(x) for x in parts]), _draw(seed, F.lit(f"family{i}"))) for i in range(5)])).otherwise(out)
    return F.initcap(out)


def surrogate(kind: Column, name: Column, attempt: Column, family: Column, key: str = KEY) -> Column:
    """Replacement of a canonical form in canonical form. A full name is drawn in two parts: `family` is the replacement of its family name, its given name has a draw of its own."""
    seed = F.concat_ws("|", F.lit(key), kind, name, attempt.cast("string"))
    octets = F.array_join(F.transform(F.split(name, r"\."), lambda o, i: F.when(F.length(o) == 1, _draw(seed, i.cast("string")) % 10).when(F.length(o) == 2, _draw(seed, i.cast("string")) % 90 + 10)
                                      .otherwise(_draw(seed, i.cast("string")) % 156 + 100).cast("string")), ".")
    hexes = F.array_join(F.transform(F.split(name, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), (_draw(seed, i.cast("string")) % 16 + 1).cast("int"), F.lit(1))), "")
    end = F.regexp_extract(name, r"(\.[A-Za-z]{2,})$", 1)
    address = F.concat(_characters(F.substring(name, F.lit(1), F.length(name) - F.length(end)), seed), end)
    # the first digit of a number stays: it tells the network of a card and the country of a phone
    number = F.concat(F.substring(name, F.lit(1), F.lit(1)), _characters(F.substring(name, F.lit(2), F.length(name)), seed, True))
    first = F.substring_index(name, " ", 1)
    drawn = F.when(attempt == 0, _draw(F.concat_ws("|", F.lit(key), kind, first), F.lit("given"))).otherwise(_draw(seed, F.lit("given")))
    given = F.lit(None).cast("string")
    for (gender, own), names in NAMES.items():
        given = F.when((kind == gender) & (_script(first) == own), _pick(F.array_remove(F.array(*[F.lit(x) for x in names]), first), drawn)).otherwise(given)
    person = F.concat(F.when(attempt < 8, given).otherwise(_syllables(first, F.concat(seed, F.lit("|given")))), F.lit(" "), family)
    return F.when(kind == "ip", octets).when(kind == "secret", hexes).when(kind == "email", address).when(kind.isin("phone", "card"), number).when(kind == "family", _syllables(name, seed)).otherwise(person)


def _formatted(kind: Column, found: Column, new: Column) -> Column:
    """A canonical replacement in the shape of a mention: its separators, its case."""
    spread = F.aggregate(F.split(found, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(
        F.regexp_like(c, F.lit(r"\d")), F.struct(F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))["out"]
    cased = F.array_join(F.transform(F.split(found, ""), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    return F.when(kind.isin("phone", "card"), spread).when(kind.isin("email", "secret"), cased).otherwise(F.when(found == F.upper(found), F.upper(new)).otherwise(new))


def _listed(hits: Column, gaps: Column) -> Column:
    """Mentions in order as (kind, found, name)."""
    found = F.transform(hits, lambda h, i: F.struct(kind_of(h, F.element_at(gaps, i + 1)).alias("kind"), h.alias("found")))
    return F.transform(found, lambda m: F.struct(m["kind"], m["found"], canonical(m["kind"], m["found"]).alias("name")))


def _last(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def names_again(persons: Column) -> Column:
    """Pattern of a text's own persons without titles: their full names, then their family names, as written or in capitals."""
    forms = F.array_distinct(F.concat(F.filter(F.transform(persons, lambda p: p["name"]), lambda n: F.instr(n, " ") > 0), F.transform(persons, lambda p: _last(p["name"]))))
    forms = F.transform(forms, lambda n: F.concat(n, F.lit("|"), F.upper(n)))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.regexp_replace(F.array_join(forms, "|"), " ", r"\\s+"), F.lit(r")(?![\p{L}\p{N}])"))


def pattern_with(names: Column) -> Column:
    return F.concat(F.lit(WHOLE + "|"), names)


def mentions(docs: DataFrame) -> DataFrame:
    """Per text with entities: its row key, `found`, the mentions in order as (kind, name, found), and `names`, the pattern of its persons' names, null without persons.

    A text with persons is searched a second time, now also for their full and family names without a title. Such a mention is of the first person it fits.
    """
    text = whole()
    rows = docs.select(text.alias("text"), *row_key("doc_id", "text")).where(F.regexp_like("text", F.lit(WHOLE)))
    # hits and gaps are columns of their own, as a lambda would search the text again for each of its elements
    rows = rows.withColumn("hits", F.regexp_extract_all("text", F.lit(WHOLE), F.lit(0))).withColumn("gaps", F.split("text", WHOLE))
    rows = rows.withColumn("found", _listed(F.col("hits"), F.col("gaps")))
    rows = rows.withColumn("persons", F.filter("found", lambda m: m["kind"].isin(*TITLES)))
    rows = rows.withColumn("names", F.when(F.size("persons") > 0, names_again(F.col("persons"))))
    more = pattern_with(F.col("names"))
    rows = rows.withColumn("hits2", F.when(F.col("names").isNotNull(), F.regexp_extract_all("text", more, F.lit(0)))).withColumn("gaps2", F.when(F.col("names").isNotNull(), F.split("text", more)))
    again = _listed(F.col("hits2"), F.col("gaps2"))
    fits = lambda m: F.get(F.filter("persons", lambda p: (p["name"] == m["name"]) | (_last(p["name"]) == m["name"])), F.lit(0))["kind"]
    found = F.when(F.col("names").isNull(), F.col("found")).otherwise(again)
    found = F.transform(found, lambda m: F.struct(F.coalesce(m["kind"], fits(m)).alias("kind"), m["name"].alias("name"), m["found"].alias("found")))
    return rows.select("k1", "k2", found.alias("found"), "names")


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, name, new) of distinct entities. Family names are drawn first, one for all persons that bear them; full names take them over."""
    names = stored(entities.select("kind", "name").distinct())
    person, full = F.col("kind").isin(*TITLES), F.instr("name", " ") > 0
    persons = names.where(person).withColumn("last", _last(F.col("name")))
    alone = names.where(~person).unionByName(persons.select(F.lit("family").alias("kind"), F.col("last").alias("name")).distinct())
    table = _drawn(alone.withColumn("family", F.lit(None).cast("string")), key)
    persons = persons.join(table.where("kind = 'family'").select(F.col("name").alias("last"), F.col("new").alias("family")), "last")
    out = table.where("kind <> 'family'").unionByName(persons.where(~full).select("kind", "name", F.col("family").alias("new")))
    return out.unionByName(_drawn(persons.where(full).select("kind", "name", "family"), key))


def _drawn(names: DataFrame, key: str) -> DataFrame:
    """(kind, name, new). Draws that meet another draw of the kind, or any entity of the kind, are repeated; the smallest name keeps a contested draw."""
    names = names.withColumn("attempt", F.lit(0))
    own = lambda: surrogate(F.col("kind"), F.col("name"), F.col("attempt"), F.col("family"), key)
    table = stored(names.withColumn("new", own()))
    real = table.select(F.col("kind").alias("k"), F.col("name").alias("real"))
    while True:
        owner = table.groupBy("kind", "new").agg(F.min("name").alias("owner"))
        judged = table.join(owner, ["kind", "new"]).join(real, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("real")), "left")
        judged = judged.withColumn("bad", (F.col("name") != F.col("owner")) | F.col("real").isNotNull())
        again = judged.select("kind", "name", "family", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), "bad", F.col("new").alias("old"))
        again = stored(again.withColumn("new", F.when(F.col("bad"), own()).otherwise(F.col("old"))))
        done = again.where("bad").isEmpty()
        table = again.select("kind", "name", "family", "attempt", "new")
        if done:
            return table.select("kind", "name", "new")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` packed as `row`, with the rewritten text and the kinds of its entities (null where there is none)."""
    found = stored(mentions(docs.select("doc_id", "text")).groupBy("k1", "k2").agg(F.any_value("found").alias("found"), F.any_value("names").alias("names")))
    each = found.select("k1", "k2", "names", F.posexplode("found").alias("pos", "m")).select("k1", "k2", "names", "pos", "m.*")
    table = surrogate_table(each.select("kind", "name"), key)
    new = each.join(table, ["kind", "name"]).withColumn("new", _formatted(F.col("kind"), F.col("found"), F.col("new")))
    new = new.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("pos", "new", "kind"))).alias("news"), F.any_value("names").alias("names"))
    rows = packed(docs).select("row", *row_key("row.doc_id", "row.text")).join(new.hint("shuffle_hash"), ["k1", "k2"], "left")
    gaps = F.when(F.col("names").isNull(), F.split(F.col("row.text"), WHOLE)).otherwise(F.split(F.col("row.text"), pattern_with(F.col("names"))))
    text = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size("news"), F.array(g, F.get(F.col("news.new"), i))).otherwise(F.array(g)))), "")
    return rows.select("row", F.when(F.col("news").isNull(), F.col("row.text")).otherwise(text).alias("text"), F.col("news.kind").alias("kinds"))


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, kinds and the rewritten text of every row of `docs`.

    A text without entities is returned as it is, a null one as null with 0 entities. Mentions are replaced wherever they stand; one entity has one surrogate in all texts and rows.
    Repeated rows give repeated results; extra columns are not read; an empty table gives no rows.
    """
    out = replaced(docs.select("doc_id", "text"), key)
    return out.select("row.doc_id", F.coalesce(F.size("kinds"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.array_join(F.array_sort(F.array_distinct("kinds")), ","), F.lit("")).alias("kinds"), "text")


def rewritten(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with surrogates in its texts and all its columns."""
    out = replaced(docs, key)
    return unpacked(out.withColumn("row", F.col("row").withField("text", F.col("text"))), docs)
