"""The training-data operators against brute force, on small and odd tables."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("ledgerlens.llm.entry")
import verify
from ledgerlens.llm import decontaminate, entry, language_id, line_dedup, packing, pseudonyms, simhash, substring_dedup, token_output, topk, url_filter
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, node string, place int"
ODD = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, "  \n \t", "en", "s", 5, None, None), (4, "one two three", "en", "s", 13, "x", 1), (4, "one two three", "en", "s", 13, "x", 1), (None, "one two three", "en", "s", 13, "x", 1), (5, "word " * 30_000, "en", "s", 150_000, "x", 1), (6, "ünïcödé 123 \U0001f600", "de", None, 12, "x", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_twin(spark, name):
    assert verify.compare(spark, verify.tables(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL).startswith("equal")


def test_topk_ties_nulls_and_repeats(spark, none):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [-0.3, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2048), (20, 2, 2, 2048), (20, 3, 6, -20 * 64)]
    assert topk.top_k(table.limit(0), F.lit(True)).count() == 0


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://a.EXAMPLE.com/en/7?x"), (4, "http://badexample.com/en/7"), (5, "http://com/en/")], "page_id long, url string")
    rules = spark.createDataFrame(entry.URL_RULES, "rule string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("a.example.com", "example.com/en/7", "allow"), 4: ("badexample.com", "com/en/", "block"), 5: ("com", "com/en/", "block")}


def test_contamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([("a", "One, TWO three!"), ("b", None), (None, "one"), ("c", "")], "item_id string, text string")
    got = decontaminate.contamination(odd, items).select("doc_id", "hits.items", decontaminate.hit_spans("text", "hits").alias("at")).collect()
    assert [(r["items"], [tuple(x) for x in r["at"]]) for r in got if r.doc_id == 4] == [(["a"], [(0, 13)])] * 2
    assert all(not r["items"] for r in got if r.doc_id in (1, 2, 3, 5, 6))
    assert decontaminate.without_contaminated(none, items).count() == 0


def test_packing_round_trip(spark, odd, none):
    path = entry.public_tokenizers.path(entry.TOKENIZER)
    words = packing.Words(path)
    rows = packing.pack(odd.coalesce(1), path).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    ids = np.append(words.ids("word " * 30_000), 1)
    assert sorted((r.start, r.length) for r in by[5])[0][0] == 0 and sum(r.length for r in by[5]) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) for r in by[5])
    assert [r.doc_tokens for r in by[1]] == [1] and len(by[4]) == 2 and all(r.sequence_tokens <= 2048 for r in rows)
    assert packing.pack(none, path).count() == 0


def test_token_output_is_a_permutation(spark, odd, tmp_path):
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = token_output.permuted(np.arange(n), n, b"k")
        assert sorted(slots.tolist()) == list(range(n)) and (token_output.permuted(slots, n, b"k", back=True) == np.arange(n)).all()
    rows = token_output.write_shards(odd, entry.public_tokenizers.path(entry.TOKENIZER), b"k", str(tmp_path / "t"), shard_rows=4).collect()
    got = list(token_output.read_slots(str(tmp_path / "t")))
    assert [s for s, _ in got] == list(range(len(rows)))
    assert {r.slot: r.row_crc32 for r in rows} == {s: zlib.crc32(x.tobytes()) for s, x in got}
    assert [s for s, _ in token_output.read_slots(str(tmp_path / "t"), 5, 3)] == [5, 6, 7]


def test_language_id_held_out(spark, odd, none):
    rows = entry.op5_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    assert language_id.known_language(none).count() == 0
    assert {r.doc_id for r in language_id.known_language(odd).collect()} & {1, 2, 3} == set()


def test_repeated_substrings_of_odd_rows(spark, odd, none):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "x " + " ".join(f"w{i}" for i in range(15)) + " y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.repeated_substrings(rows).collect()}
    assert got[1][1] == 0 and got[2] == (17, 15, "x y") and got[3][:2] == (0, 0)
    assert substring_dedup.repeated_substrings(odd).count() == len(ODD) and substring_dedup.repeated_substrings(none).count() == 0


def test_repeated_substrings_by_brute_force(spark):
    rng, window = random.Random(3), substring_dedup.WINDOW
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice("ab") for _ in range(rng.randrange(40))]
        cut = rng.randrange(30)
        rows.append((i // 2 if i < 20 else i, " ".join(words[:9] + passage[cut : cut + rng.randrange(30)] + words[9:])))
    rows += [rows[4], rows[5], rows[5], (None, rows[0][1])]
    first: dict[tuple, int] = {}
    for d, text in rows:
        w = text.split()
        for i in range(len(w) - window + 1) if d is not None else ():
            first[tuple(w[i : i + window])] = min(d, first.get(tuple(w[i : i + window]), d))
    want = []
    for d, text in rows:
        w = text.split()
        off = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        want.append((d, len(w), len(off), " ".join(x for i, x in enumerate(w) if i not in off)))
    got = substring_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 20
    assert all(r.n_removed == sum(s.last - s.first + 1 for s in r.repeats) for r in got)


def test_repeated_substrings_with_clashing_columns(spark):
    plain = spark.createDataFrame([(2, "a b c d e f g h i j k l m n"), (1, "x a b c d e f g h i j k l m n")], "doc_id long, text string")
    clashing = plain.selectExpr("*", "'q' run", "3 anchor", "array(1) windows", "array(2) places", "7 n_removed")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_text").collect()))
    assert key(substring_dedup.repeated_substrings(clashing)) == key(substring_dedup.repeated_substrings(plain)) == [(1, 15, 0, "x a b c d e f g h i j k l m n"), (2, 14, 14, "")]


def test_fuzzy_lines(spark, odd, none):
    base = " ".join(f"word{chr(97 + i)}" for i in range(26))
    rows = spark.createDataFrame([(1, f"First line here\n{base} end\n\n"), (2, f"FIRST line, here!\nown words\n{base} end."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(rows).collect()}
    assert got == {1: f"First line here\n{base} end\n\n", 2: "own words", 3: None}
    assert line_dedup.deduplicated(odd).count() == len(ODD) and line_dedup.deduplicated(none).count() == 0


def test_pseudonyms_keep_format_and_links():
    text = "Card 4111 1111 1111 1111, born 1990-02-28, mail Ann.Lee7@example.org, again 4111111111111111"
    new, found = pseudonyms.replaced(text, b"k")
    assert len(new) == len(text) and [x["kind"] for x in found] == ["card", "date", "email", "card"]
    digits = [pseudonyms._only_digits(new[x["start"] : x["end"]]) for x in found if x["kind"] == "card"]
    assert digits[0] == digits[1] and pseudonyms.luhn_digit(digits[0][:-1]) == digits[0][-1] and digits[0] != "4111111111111111"
    assert sorted(pseudonyms.permute(i, 1000, b"k", "x") for i in range(1000)) == list(range(1000))


def test_simhash_components_by_brute_force(spark, odd):
    rows = entry.op10_simhash(spark, SMALL).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    parent = {d: d for d in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in rows} == {d: find(d) for d in ids}
    kept = [r.doc_id for r in simhash.first_of_each_group(odd).collect()]
    assert kept.count(4) == 1 and kept.count(1) == 1 and 2 not in kept and kept.count(None) == 1


def test_pipeline_keeps_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out.persist()


def test_tokens_from_parts_equal_whole_encodings():
    import random

    import public_tokenizers

    words, made = packing.Words(public_tokenizers.path(entry.TOKENIZER)), random.Random(1)
    assert words.takes_apart
    signs = "aAbBzZ019'.,-_éÉñß́̊WwİσΣς§½²٣\t中ǅ%@( ​क़"
    for _ in range(30_000):
        text = "".join(made.choice(signs) for _ in range(made.randint(0, 9)))
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_near_duplicates_by_brute_force(spark, odd, none):
    import random

    import corpus_pipeline
    from ledgerlens.llm import shingles

    made = random.Random(3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    for k in range(150):
        base = [made.choice("abcdefghij") + str(made.randint(0, 400)) for _ in range(made.randint(5, 200))]
        docs.append((10_000 + 10 * k, " ".join(base)))
        for m in range(made.randint(1, 3)):  # a chain of ever further copies
            for _ in range(made.randint(1, 4)):
                base[made.randrange(len(base))] = f"new{made.randint(0, 10**6)}"
            docs.append((10_001 + 10 * k + m, " ".join(base)))
    sets = {d: {w[i : i + 5] for w in [tuple((t or "").lower().split())] for i in range(max(1, len(w) - 4)) if w} for d, t in docs}
    parent, ids, pairs = {d: d for d in sets}, sorted(sets), 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if 9 * shared >= 4 * (len(sets[a]) + len(sets[b])):
                pairs += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert pairs > 100
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, SMALL).collect()) == [d for d in ids if find(d) == d]
    kept = [r.doc_id for r in shingles.first_of_each_group(odd).collect()]
    assert kept.count(4) == 1 and kept.count(1) == 1 and 2 not in kept and kept.count(None) == 1
    assert shingles.first_of_each_group(none).count() == 0
    twins = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z")], "doc_id long, text string")
    assert sorted(r.text for r in shingles.first_of_each_group(twins).collect()) == ["a b c d e f", "u v w x y z"]


def test_added_tokens_keep_their_ids():
    import random

    words, made = packing.Words(entry.public_tokenizers.path(entry.TOKENIZER)), random.Random(2)
    pieces = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "Bé", "Word,", "é", "1", " ", "\n", "'s", "<", "|", "İ"]
    assert words.ids("a <|endoftext|> b").tolist().count(49407) == 1
    for _ in range(5_000):
        text = "".join(made.choice(pieces) for _ in range(made.randint(0, 6)))
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("value, kind", [("DE89 3704 0044 0532 0130 00", "iban"), ("GB29NWBK60161331926819", "iban"), ("FR14 2004 1010 0505 0001 3M02 606", "iban"), ("+33 6 12 34 56 78", "phone"), ("+44 7911 123456", "phone"), ("+33612345678", "phone"), ("+1 (415) 555-2671", "phone"), ("+47 22 12 34 56", "phone"), ("+44 (0)20 7946 0958", "phone"), ("415-555-2671", "phone")])
@pytest.mark.parametrize("after", ["", ".", " BIC COBADEFF", " 12 March", " ABC", ", 7", " and more"])
def test_planted_ibans_and_phones(value, kind, after):
    if kind == "phone" and value[0] == "+" and after == " 12 March":
        after = " / 12 March"  # more groups of an international number may as well be its own
    text = f"call or pay {value}{after}"
    new, found = pseudonyms.replaced(text, b"k")
    assert found == [{"kind": kind, "start": 12, "end": 12 + len(value)}]
    assert len(new) == len(text) and new[:12] == text[:12] and new[12 + len(value) :] == after and value not in new
    if kind == "iban":
        plain = new[12 : 12 + len(value)].replace(" ", "")
        assert pseudonyms.iban_check(plain[:2], plain[4:]) == plain[2:4]


def test_rare_languages_are_learned_whole_and_unlearned_ones_go(spark):
    rows = [(i, f"the water and the house {i}", "en") for i in range(5_000)] + [(5_000 + i, f"вода и дом {i} земля", "ru") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prior, matrix = language_id.fit(table, max_rows=200)
    alone = language_id.fit(table.where("lang = 'ru'"))[2]
    assert langs == ["en", "ru"] and np.allclose(matrix[1], alone[0]) and np.allclose(np.exp(prior), [5000 / 5030, 30 / 5030])
    assert [language_id.equal_quota(*x) for x in (([5, 1], 6), ([5, 3], 6), ([9, 1, 9], 11))] == [float("inf"), 3, 5]
    other = spark.createDataFrame([(6_000, "το νερό και το σπίτι είναι εδώ", None), (6_001, "the house and the water", None)], table.schema)
    kept = {r.doc_id for r in language_id.known_language(table.union(other)).collect()}
    assert 6_000 not in kept and 6_001 in kept and len(kept) >= 5_020


def test_no_two_dates_share_a_pseudonym():
    from calendar import monthrange

    days = [(y, m, d) for y in range(1900, 2100) for m in range(1, 13) for d in range(1, monthrange(y, m)[1] + 1)]
    written = {f"{d:02d}/{m:02d}/{y}" for y, m, d in days} | {f"{m:02d}/{d:02d}/{y}" for y, m, d in days} | {f"{d}.{m}.{y}" for y, m, d in days[:9000]} | {f"{y}-{m:02d}-{d:02d}" for y, m, d in days[:9000]}
    new = {s: pseudonyms._date(s, b"k") for s in written}
    assert len(set(new.values())) == len(written) and all(len(a) == len(b) for a, b in new.items())
    assert pseudonyms._date("29.02.2023", b"k") is None and pseudonyms._date("13.13.2020", b"k") is None


def test_pseudonyms_keep_widths_and_country_codes():
    for text in ("10.0.0.1", "192.168.1.77", "1/2/1990", "31.12.0999"):
        new, found = pseudonyms.replaced(text, b"k")
        assert len(found) == 1 and new != text and [len(x) for x in new.replace("/", ".").split(".")] == [len(x) for x in text.replace("/", ".").split(".")]
    assert [pseudonyms._phone(x, b"k")[: len(c)] for x, c in (("+4915123456789", "+49"), ("+14155552671", "+1"), ("+353861234567", "+353"))] == ["+49", "+1", "+353"]


def test_pseudonyms_of_odd_rows(spark, odd, none):
    rows = pseudonyms.pseudonymised(odd.withColumn("found", F.lit(1)), b"k" * 80).collect()
    assert len(rows) == len(ODD) and all(r.found == [] for r in rows)
    assert sorted((r.text or "") for r in rows) == sorted((x[1] or "") for x in ODD)
    assert pseudonyms.pseudonymised(none, b"k").count() == 0


def test_one_changed_word_or_letter_is_found(spark):
    import random

    made, rows, n = random.Random(5), [], 0
    word = lambda: "".join(made.choice("abcdefghijklmnoprstuvw") for _ in range(made.randint(2, 9)))
    for length in (6, 10, 20, 40, 100):
        for k in range(60):
            line = [word() for _ in range(length)]
            other = list(line)
            i = max(range(length), key=lambda j: (len(line[j]) == 5, len(line[j]) == 4))  # a word that isn't long
            other[i] = word()[:5] if k % 2 else other[i][:-1] + "x"
            rows += [(n, " ".join(line)), (n + 1, " ".join(other))]
            n += 2
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(table).collect()}
    found = {length: sum(left[i + 1] == "" for i in range(120 * k, 120 * k + 120, 2)) for k, length in enumerate((6, 10, 20, 40, 100))}
    assert all(left[i] for i in range(0, n, 2)) and all(x >= 54 for x in found.values()), found


def test_line_positions_turn_back(spark):
    places = [(-5, 3), (-5, 0), (0, 0), (7, 9), (2**62, 5), (-(2**62), 2**31 - 1)]
    rows = spark.createDataFrame(places, "doc_id long, line_no int").withColumn("pos", line_dedup.position())
    assert sorted(tuple(r) for r in rows.select(*line_dedup.place_of()).collect()) == sorted(places)
