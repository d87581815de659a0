"""Every operator against brute force on one small table of awkward rows, on an empty table, and with clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecwatch.llm import bpe, catalog, exact_dedup, language, lexical, license_texts, licenses, merkle, mixing, near_dedup, perspectives, quality, substrings, surrogates, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, row string, key string, sid long, _k long"


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdeéß"), r.integers(2, 7))) for _ in range(n))


def rows():
    base, passage = prose(1, 200), prose(2, 60)
    words = base.split()
    near = [" ".join([*words[:i], "edited", *words[i + 1 :]]) for i in (5, 90, 150)]
    far = " ".join([*words[:100], *prose(3, 100).split()])
    texts = [None, "", " \n\t ", "one", base, base.replace(" ", "\n", 3), base.upper(), *near, far, prose(4, 50) + " " + passage + " " + prose(5, 50), passage + "\n" + passage,
             prose(6, 4000), "x " * 3000, "Licensed under CC BY-NC 4.0. All rights reserved. all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache Licence", "write to a.b1@mail.example.com or +1 (555) 010-7777, +15550107777; 10.2.3.44 4111111111111111", "same A.B1@mail.example.com Mrs Alma Krüger met Mr Иван Петров",
             "<|endoftext|>İ😀 don't 12½", *(prose(20 + i, 30 + i % 7) for i in range(150))]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), i, "r", "k", 1, 2) for i, t in enumerate(texts)]
    out[40] = out[39]  # a repeated row
    out.append((None, base, None, "s1", None, None, None, None, None, None))
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 170, 2)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().split()


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[15]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 2, 10, "cc-by,reserved") and r.labels == "cc-by,cc-by-nc,reserved" and r.score == 1.0
    assert got[16].labels == "gpl,gpl-3.0" and got[17].labels == "" and got[0].n_words == 0 and got[0].first_word is None and got[0].score == 0.0
    assert got[16].spans[0].start == 0 and got[16].spans[0].label == "gpl-3.0"
    con = duckdb.connect()
    table = docs.select("doc_id", "text").toArrow()
    con.register("documents", table)
    cur = con.execute(licenses.scan_sql())
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert want == sorted(str(tuple(getattr(r, n) for n in names)) for r in licenses.scan(docs).collect())


def test_template_markup():
    with pytest.raises(ValueError):
        licenses.parse("a <<beginOptional>> b")
    machine = licenses.Automaton.of([("x", 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name="v";words="0-2">> d')])
    accepted = {t for t in map(" ".join, itertools.chain.from_iterable(itertools.product("abcd", repeat=n) for n in range(1, 6))) if any(e == len(t.split()) for _, _, e in machine.match(t.split(), 0))}
    want = {t for n in range(1, 6) for t in map(" ".join, itertools.product("abcd", repeat=n)) if re.fullmatch(r"a (b (c )?)?(\w ){0,2}d", t)}
    # the longest span is reported, so a text is accepted as a whole if and only if the expression matches it
    assert accepted == want


def license_labels(text):
    """By the automaton, which has to agree with the expressions the SQL uses."""
    w = licenses.words_of(text)
    got = {label for i in range(len(w)) for label, _, _ in LICENSES.match(w, i)}
    assert got == {label for label, t in licenses.TEMPLATES if re.search(" " + licenses.expression(licenses.parse(t)), f" {' '.join(w)} ")}
    return ",".join(sorted(got))


LICENSES = licenses.Automaton.of(licenses.TEMPLATES)
PLAIN = lambda t: licenses.MARK.sub("", t.replace(license_texts.HOLDER, " the authors "))


def test_whole_licenses():
    mit = PLAIN(license_texts.MIT)
    assert license_labels(f"x {mit}.") == "mit" and license_labels(mit[:-30]) == ""
    assert license_labels(mit.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED")) == ""  # the JSON license
    head, tail = PLAIN(license_texts.BSD_HEAD), PLAIN(license_texts.BSD_TAIL)
    names = "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University."
    assert license_labels(f"{head} {tail}") == "bsd-2-clause" and license_labels(f"{head} 3. {names} {tail}") == "bsd-3-clause" and license_labels(f"{head} {advert} 4. {names} {tail}") == "bsd-4-clause"
    assert license_labels(head) == ""


@pytest.mark.parametrize("text,want", [
    ("Licensed under the MIT License", "mit"), ("Released under the Apache License", "apache"), ("under the Apache License, Version 1.1", "apache,apache-1.1"), ("available under the ISC license", "isc"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl-2.0"),
    ("distributed under GPLv3", "gpl-3.0"), ("under the GNU LGPL 2.1", "lgpl-2.1"), ("under the GNU Lesser General Public License, version 3", "lgpl-3.0"), ("under the GNU Affero General Public License v3.0", "agpl-3.0"),
    ("subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("licensed under CC BY 4.0", "cc-attribution"), ("licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"), ("under the BSD 3-Clause License", "bsd-3-clause"), ("Licensed under the Apache Licence", "")])
def test_license_notices(text, want):
    assert license_labels(text) == want


@pytest.mark.parametrize("bits", [4, 20])
def test_substrings(docs, bits):
    got = Counter(tuple(r) for r in substrings.substring_dedup(docs, width_bits=bits).collect())
    count = Counter(tuple(w[i : i + 35]) for w in (words(r[1]) for r in ROWS) for i in range(len(w) - 34))
    want = Counter()
    for r in ROWS:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    assert got == want


def test_quality(docs):
    for r in quality.quality(docs, least_group=20).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        w = words(text)
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and (not r.base_failed or not r.kept)
        assert r.kept or r.base_failed  # clean prose stays


def test_quality_rejects_an_outlier(spark):
    data = [(i, prose(i, 60), "en", "s") for i in range(120)] + [(999, " ".join(w + "###" for w in prose(7, 60).split()), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(999) and all(got.values())


def test_quality_rejects_moderate_shares(spark):
    """4 % symbols, or 20 % of words in repeated windows, among clean prose; one stray symbol or one repeated window in a long text stays."""
    clean = [(i, prose(i, 150)) for i in range(150)]
    symbols, again, stray = prose(900, 150).split(), prose(901, 150).split(), prose(902, 150).split()
    for i in range(0, 150, 6):
        symbols[i] = "|"
    again[100:115] = again[20:35]
    long = prose(903, 800).split()
    long[400:408] = long[20:28]
    data = clean + [(990, " ".join(symbols)), (991, " ".join(again)), (992, " ".join([*stray, "&"])), (993, " ".join(long))]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(*x, "en", "s") for x in data], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i, r in got.items() if not r.kept] in ([990, 991], [991, 990])


def test_mixing(docs):
    got = mixing.mix_report(docs, block_words=8, shard_slots=64).collect()
    assert Counter(got) == Counter(mixing.mix_report(docs.repartition(2), block_words=8, shard_slots=64).collect())
    source = {r[0]: r[3] for r in ROWS}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(words(r[1]))
    target, rest = {}, {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    while rest:
        left = sum(size.values()) - sum(target.values())
        share = {n: left * w / sum(rest.values()) for n, w in rest.items()}
        over = [n for n in rest if share[n] > 3 * size[n]]
        target |= {n: 3.0 * size[n] for n in over} if over else share
        rest = {n: w for n, w in rest.items() if n in over} and {n: w for n, w in rest.items() if n not in over}
        if not over:
            break
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 24 for s in names)
    out = Counter()
    for r in mixing.mixed_documents(docs.where("doc_id not in (39, 40)"), block_words=8).collect():
        out[r.doc_id] += len(words(r.text))
    assert out == +Counter({r.doc_id: r.taken for r in mixing.mix_report(docs.where("doc_id not in (39, 40)"), block_words=8).collect()})


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 3, F.lit("x"))).collect()]
        assert sorted(got) == list(range(n))


def test_toxicity_learns_and_generalises(spark):
    r = np.random.default_rng(0)
    data = []
    for i in range(900):
        w = prose(1000 + i, 40).split()
        bad = i % 5 == 0
        if bad:
            for j in r.choice(40, 3, replace=False):
                w[j] = r.choice(["idiotic", "moronish", "scumbag"])
        data.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()}
    held = [(got[i].predicted, y) for i, _, y in data if got[i].held_out]
    assert len(held) > 150 and sum(p == y for p, y in held) / len(held) > 0.85  # one class alone: 0.8
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    score = lambda w: model.weights[toxicity.subwords([w])[0]].mean()
    assert score("scumbagg") > 5 * abs(score("acdbe"))  # a spelling never seen


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(docs, n):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [(r[0], shingles(r[1])) for r in ROWS]
    group = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
    want = Counter()
    for i, (d, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if group[j] == group[i] and sets[j][0] is not None]
        c = min(ids) if s and ids else d
        want[(d, len(s), c, d == c)] += 1
    assert Counter(tuple(r) for r in near_dedup.near_dedup(docs, n).collect()) == want
    kept = near_dedup.keep_representatives(docs, n)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({k[0] for k in want if k[3]})


def test_near_group_around_a_base(spark):
    """Copies that are far from one another but near their source, some too far from it: components as brute force has them."""
    base, r, data = prose(50, 120).split(), np.random.default_rng(1), []
    for i in range(60):
        w = list(base)
        for j in r.choice(120, r.integers(1, 9), replace=False):
            w[j] = f"e{r.integers(0, 40)}"
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets = [set(near_dedup.shingle_set(t.encode(), 4).tolist()) for _, t in data]
    group = list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = sorted((group[i], group[j]))
            group = [x if g == y else g for g in group]
    want = {i: min(j for j in range(60) if group[j] == group[i]) for i in range(60)}
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, 4).collect()} == want


def test_far_pairs_with_a_common_passage(spark, monkeypatch):
    """Texts that share a passage and a key, but are no links, are not told as pairs; pairs among them that are links are found."""
    passage, data = prose(60, 56), []
    for i in range(80):
        own = prose(1000 + i, 34)
        data += [(2 * i, f"{passage} {own}"), (2 * i + 1, f"{passage} {own} {prose(3000 + i, 4)}" if i % 8 == 0 else f"{passage} {prose(5000 + i, 34)}")]
    told, asked = near_dedup.stored, []
    monkeypatch.setattr(near_dedup, "stored", lambda df: (asked.append(told(df)), asked[-1])[1])
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()}
    assert got == {i: i - 1 if i % 16 == 1 else i for i in range(160)}
    pairs = [df.count() for df in asked if {"root_x", "root_y"} <= set(df.columns) or df.columns == ["a", "b"]]
    assert max(pairs) < 160 * 10


@pytest.mark.parametrize("size", [bpe.SLICE_BYTES, 200])
def test_bpe(docs, size):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.tokenizer_file())
    want = Counter()
    for r in ROWS:
        ids = made.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.bpe(docs, slice_bytes=size).collect()) == want


def test_bpe_exchange(spark):
    """What a slice sends to meet other slices grows by buckets, not by a row for each of its words; all ids come back in place."""
    from tokenizers import Tokenizer

    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000)), "wa wa wb", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    definition = bpe.definition_of(bpe.tokenizer_file())
    inner = docs.select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.word_ids(bpe.sliced(inner, definition, bpe.SLICE_BYTES, True), definition)
    assert 0 < back.count() <= 2000
    made = Tokenizer.from_file(bpe.tokenizer_file())
    got = {r.row.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encoded(docs, definition).collect()}
    assert got == {i: made.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_surrogates(docs):
    got = {r.doc_id: r for r in surrogates.surrogates(docs).collect()}
    assert got[0].text is None and got[4].text == ROWS[4][1] and got[4].n_entities == 0
    a, b = got[18].text, got[19].text
    assert got[18].kinds == "card,email,ip,phone" and got[19].kinds == "email,female,male"
    assert not re.search("a.b1@mail|010-7777|10\\.2\\.3\\.44|4111111111111111", a) and "Krüger" not in b and "Петров" not in b
    first, second = re.search(r"\S+@\S+", a)[0], re.search(r"\S+@\S+", b)[0]
    assert first == second.lower() and first != second  # one entity, each in its own case
    phones = re.findall(r"\+1[ \d()-]+\d", a)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    assert re.search(r"Mr [А-Я][а-я]+ [А-Я][а-я]+", b)


def test_surrogates_of_persons(spark):
    """Later mentions without a title go too, parts of a name agree everywhere, other scripts and national phones are found."""
    data = [(1, "Mr Ivan Petrov came. Ivan Petrov spoke, Petrov's wife left. PETROV stays; Petrovich too"), (2, "then Mr Petrov met Mrs Anna Petrov"), (3, "Petrov without a title"),
            (4, "г-н Иван Сидоров и Сидоров"), (5, "κ. Νίκος Παππάς και Παππάς"), (6, "call (017) 555-7713 or +375 17 555-7713"), (7, "Mr Oleg Petrov")]
    got = {r.doc_id: r for r in surrogates.surrogates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    given, family = re.match(r"Mr (\w+) (\w+) came", got[1].text).groups()
    assert {given, family} & {"Ivan", "Petrov"} == set()
    assert got[1].text == f"Mr {given} {family} came. {given} {family} spoke, {family}'s wife left. {family.upper()} stays; Petrovich too" and got[1].n_entities == 4
    assert re.fullmatch(rf"then Mr {family} met Mrs \w+ {family}", got[2].text) and got[3].text == data[2][1]
    assert re.fullmatch(r"г-н [А-Я][а-я]+ ([А-Я][а-я]+) и \1", got[4].text) and "Сидоров" not in got[4].text
    assert re.fullmatch(r"κ\. \w+ (\w+) και \1", got[5].text) and "Παππάς" not in got[5].text
    assert got[6].n_entities == 2 and re.fullmatch(r"call \(\d{3}\) \d{3}-\d{4} or \+\d{3} \d\d \d{3}-\d{4}", got[6].text) and "555-7713" not in got[6].text
    other = re.fullmatch(rf"Mr (\w+) {family}", got[7].text)[1]
    assert other not in (given, "Oleg")


def test_surrogates_stay_distinct(spark):
    data = [(i, f"at {i // 10}.{i % 10}.0.1 now") for i in range(90)]
    out = surrogates.surrogates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    found = {re.search(r"\d+\.\d+\.\d+\.\d+", r.text)[0] for r in out}
    assert len(found) == 90 and not found & {t.split()[1] for _, t in data}


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, None, "ann", "late", "x"), (2, 0, "system", "alone", "x"), (None, 5000, None, "void", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, segment string")
    got = {(r.conv_id, r.participant): r for r in perspectives.dialogues(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    r = got[1, "bob"]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=ann\nlate<|im_end|>\n"
    assert [got[1, "ann"].text[m.start : m.end] for m in got[1, "ann"].masks] == ["hi<|im_end|>\n", "late<|im_end|>\n"]
    assert perspectives.perspectives(df.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [1, 2])
def test_exact_dedup(docs, rounds):
    group = defaultdict(list)
    norm = lambda t: re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())
    for r in ROWS:
        group[norm(r[1])].append(r[0])
    want = Counter()
    for r in ROWS:
        own = group[norm(r[1])]
        keep = min((x for x in own if x is not None), default=None)
        want[(r[0], keep, len(own), r[0] == keep, hashlib.sha256(norm(r[1])).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, rounds).collect()) == want
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want if k[3])


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_brute(rows):
    """Levels of pairs per language, then over languages; proofs and folds by walking."""
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        return sha(*map(enc, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        steps = []
        for level in tree[:-1]:
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            steps.append((run[: i % 2], run[i % 2 + 1 :]))
            i //= 2
        return steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = Counter()
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, int(bad))
            for left, right in steps:
                now = sha(*left, now, *right)
            out[(r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[x for left, right in steps for x in (*left, *right)]), now, now == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("digits", [1, 3, 8])
def test_merkle(docs, digits):
    got = Counter(tuple(r) for r in merkle.merkle(docs, digits).collect())
    assert got == merkle_brute(ROWS) and any(not k[-1] for k in got)


def test_merkle_of_one_row(spark):
    docs = spark.createDataFrame([(7, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.merkle(docs).first()
    assert r.leaf == r.subroot == r.root == sha("1:7", "-", "-", "-", "1:a") and r.proof_sha256 == sha() and r.verified


def test_merkle_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source", "lang", "n_chars", "text").toArrow())
    assert sorted(map(str, con.execute(merkle.SQL).fetchall())) == sorted(str(tuple(r)) for r in merkle.merkle(docs).collect())


ITEMS = [(1, "The cat sat; the CAT ran."), (2, None), (3, "zzz unseen"), (4, ROWS[4][1]), (4, "x x x"), (None, "edited über edited"), (6, " ".join(ROWS[13][1].split()[:300]))]


@pytest.mark.parametrize("options", [{}, {"bits": 1, "rows": 8}, {"at_once": 2, "k": 3}])
def test_lexical(spark, docs, options):
    """Against every document scored for every item; with one bit per entry the signatures say little and all is left to the exact step."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    counts = [(r[0], Counter(split(r[1]))) for r in ROWS]
    held = [(d, c) for d, c in counts if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    want = Counter()
    for item, text in ITEMS:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(scores)[: options.get("k", 20)], 1):
            want[item, rank, None if none else d, -score] += 1
    assert Counter(tuple(r) for r in lexical.search(docs, items, **options).collect()) == want


def test_signatures_never_deny_a_term(docs):
    """Bounds are never below a score, whatever the number of bits."""
    for bits in (1, 16):
        asked = lexical.Asked.of(docs, [ROWS[4][1].encode(), b"x x"], 150, 12000, 20)
        names = lexical.word_hashes(asked.terms)
        for row in lexical.signatures(docs, bits, 16).collect():
            bound = lexical._bounds(asked, names, row.asDict(), [0, 1])
            for j, d in enumerate(row.doc_ids):
                c = Counter(lexical.terms((dict((r[0], r[1]) for r in ROWS)[d]).encode()))
                m = int(asked.norms(np.array(sum(c.values()))))
                for i, own in enumerate(asked.items):
                    score = sum(int(asked.weights[t]) * lexical.gains(c[asked.terms[t]], m) for t in own.tolist() if c[asked.terms[t]])
                    assert bound[i, j] >= score and (sum(c.values()) == row.sizes[j])


LANGS = {"aa": "bado gime talu rosi nema", "bb": "strux klorf gnash wemth prisk", "cc": "добро снега ветер книга звери"}


def speech(lang, seed, n):
    r = np.random.default_rng(seed)
    units = [w[i : i + 2] for w in LANGS[lang].split() for i in range(0, len(w) - 1, 2)]
    return " ".join("".join(r.choice(units, r.integers(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, speech("abc"[i % 3] * 2, i, 30), "abc"[i % 3] * 2) for i in range(240)]
    mixed_text = speech("aa", 900, 40) + ". " + speech("bb", 901, 25) + " " + speech("aa", 902, 30)
    rows += [(900, mixed_text, "aa"), (901, None, "bb"), (902, "", "aa"), (903, "12 !? 34", "aa"), (904, speech("cc", 905, 3000), None), (904, speech("cc", 905, 3000), None), (None, speech("bb", 7, 12), "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit("x"))


def test_language(spoken):
    got = language.language(spoken).collect()
    by_id = {r.doc_id: r for r in got}
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(got) == 247 and len(held) > 30 and all(r.lang_pred == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (901, 902, 903, 904, None)] == ["und", "und", "und", "cc", "bb"] and by_id[901].score == 0
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_spans(spoken):
    model = language.fit(spoken)
    r = language.labelled(spoken.where("doc_id = 900"), model).first()
    assert [(s.lang, s.first_word, s.words) for s in r.spans] == [("aa", 0, 40), ("bb", 40, 25), ("aa", 65, 30)] and r.lang_pred == "aa"
    cyrillic = model.scores(["добро"])[0]
    assert cyrillic[2] == 0 and cyrillic[0] == cyrillic[1] == -language.SPREAD  # the script leaves one candidate


def test_viterbi_and_its_shortcut():
    """The walk against all paths; the shortcut says yes only where the constant path is the best."""
    r = np.random.default_rng(3)
    for trial in range(60):
        scores = -np.abs(r.normal(0, 3, (6, 3)))
        value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=6)))
        path = language.viterbi(scores, 2.0).tolist()
        assert abs(value(path) - best) < 1e-9
        top = int(scores.sum(axis=0).argmax())
        if language.constant(np.arange(6), np.array([0]), scores, np.array([top]), 2.0)[0]:
            assert path == [top] * 6


def test_grams_are_those_of_each_word():
    words = ["ab", "c", "déf"]
    found, of = language.grams(words, 1 << 40)
    for i, w in enumerate(words):
        alone = language.grams([w], 1 << 40)[0]
        assert sorted(found[of == i].tolist()) == sorted(alone.tolist())
    assert len(language.grams(["ab"], 1 << 40)[0]) == 2 + 3 + 2 + 1  # a b, _a ab b_, _ab ab_, _ab_


def test_toxicity_of_awkward_rows(spark, docs, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS)
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.score)
    assert len({of[i].pop() for i in (0, 1, 2)}) == 1 and len(of[39]) == 1  # null, empty and blank texts score alike, and so do repeated rows
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_subwords_are_those_of_each_word():
    words = ["ab", "c", "déf"]
    found, of = toxicity.subwords(words)
    for i, w in enumerate(words):
        assert sorted(found[of == i].tolist()) == sorted(toxicity.subwords([w])[0].tolist())
    assert len(toxicity.subwords(["ab"])[0]) == 3 and len(toxicity.subwords(["c"])[0]) == 1  # itself, _ab without one mark each; only itself


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    for made in (licenses.scan(none), substrings.substring_dedup(none, width_bits=10), quality.quality(none), mixing.mix_report(none), mixing.mixed_documents(none), toxicity.toxicity(none, labels.limit(0)),
                 near_dedup.near_dedup(none), near_dedup.keep_representatives(none), bpe.bpe(none), surrogates.surrogates(none), exact_dedup.exact_dedup(none), exact_dedup.keep_first(none),
                 merkle.merkle(none), language.language(none), lexical.search(none, docs.select(F.col("doc_id").alias("item_id"), "text")), lexical.search(docs, none.select(F.col("doc_id").alias("item_id"), "text"))):
        assert made.count() == 0


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) > 0
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        if name != "source_mixing":
            assert not Counter(map(str, out.collect())) - Counter(map(str, now.collect()))
        now = out.cache()
    texts = [r.text for r in now.collect()]
    assert sum(re.sub(r"\s+", " ", t or "").lower() == ROWS[4][1] for t in texts) <= 3  # at most the copies that mixing makes


@pytest.mark.parametrize("build", [
    lambda docs: toxicity.scored(docs, toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)), lambda docs: near_dedup.signatures(docs, 4),
    lambda docs: bpe.encoded(docs, bpe.definition_of(bpe.tokenizer_file()))], ids=["toxicity", "near_dedup", "bpe"])
def test_batches_of_whole_texts_are_bounded_in_bytes(spark, build):
    """No batch that an operator sends to Python is much larger than the bound, whatever its number of rows and the session's setting before."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 250).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    out = build(docs)

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    sizes = docs.mapInArrow(told, "size long, n long").collect()
    assert sum(r.n for r in sizes) == 4000 and max(r.size for r in sizes) < 5 << 20
    if "row" in out.columns and "score" in out.columns:  # every row comes back, over the bounds of batches
        assert out.select("row.doc_id").distinct().count() == out.count() == 4000


def test_registered():
    names = list(catalog.queries())
    assert [n for n in names if n.startswith("op")] and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and set(catalog.oracle_sql()) <= set(names)


def test_near_components_in_small_plans(spark, monkeypatch):
    """A step of the rounds reads each table once or twice: what stands several times in one plan is broadcast by the driver several times at once. More links join the components found before."""
    chains = [[(10 * i, 10 * i + 1) for i in range(4)], [(3, 2), (5, 3), (5, 40), (7, 6)], [(1, 10), (40, 2), (8, 9), (6, 7), (30, 31)]]
    links = [spark.createDataFrame(x, "a long, b long") for x in (chains[0] + chains[1], chains[2])]
    told, reads = near_dedup.stored, []
    monkeypatch.setattr(near_dedup, "stored", lambda df: (reads.append(df._jdf.queryExecution().analyzed().collectLeaves().size()), told(df))[1])

    def want(pairs):
        least = {x: x for pair in pairs for x in pair}
        for _ in least:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    first = near_dedup.components(links[0])
    assert {r.cls: r.root for r in first.collect()} == want(chains[0] + chains[1])
    assert max(reads) <= 3
    got = [(r.cls, r.root) for r in near_dedup._joined_roots(first, links[1]).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want(sum(chains, []))
