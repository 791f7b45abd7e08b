"""Each operator against brute force on awkward texts, empty tables and clashing columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.llm import common, decontaminate, langid, linededup, mixing, mpegaudio, simhash, suffixdedup, surrogates, tokenbin, wordpiece


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


# ---- decontamination


def test_decontamination_is_brute_force(documents, texts, items):
    rows, table = items
    assert by_id(decontaminate.op1_decontaminate(documents, table)) == decontaminate.brute_force(texts, rows)


def test_items_without_id_hit(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "so " + passage), (2, "nothing of it"), (3, passage + " and other words")]
    rows = [(None, passage), (None, "and other words"), (7, "eleven and other")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    got = by_id(decontaminate.op1_decontaminate(*tables))
    assert got == decontaminate.brute_force(docs, rows) and [got[d][:3] for d in (1, 2, 3)] == [(12, 11, 1), (3, 0, 0), (14, 14, 2)]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(decontaminate.SQL).fetchall()} == got


def test_decontamination_in_blocks_is_the_same(documents, items):
    _, table = items
    whole = decontaminate.measure(documents, table).drop("items").collect()
    blocks = decontaminate.measure(documents, table, block_words=40).drop("items").collect()
    assert sorted(map(str, whole)) == sorted(map(str, blocks))


def test_items_may_be_repeated(spark):
    rows = [(i % 3, "some words that are in a few of the items, all of them together here") for i in range(40)] + [(None, "of the items")]
    docs = [(1, "It is some words that are in a few of the items, all of them together here."), (2, None)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    assert by_id(decontaminate.op1_decontaminate(*tables)) == decontaminate.brute_force(docs, rows)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "hashed", lambda ws: np.array([len(w) % 2 for w in ws], np.uint64))
    items = [("a", b"one two six"), ("b", b"six one two"), ("c", b"one two six"), ("d", b"nine four")]
    found = decontaminate.NgramSet(items, 2)
    assert {(i, n): s for i, n, s in found.scan(b"two six one two four nine".split())} == {(0, 2): {"a", "c"}, (1, 2): {"b"}, (2, 2): {"a", "b", "c"}}


def test_decontamination_removes_documents_or_spans(documents, items, empty):
    _, table = items
    left = decontaminate.decontaminate(documents, table)
    assert left.columns == documents.columns and decontaminate.measure(left, table).filter("contaminated").isEmpty()
    cut = decontaminate.decontaminate(documents, table, remove="spans")
    assert cut.count() == documents.count()
    assert decontaminate.decontaminate(empty, table).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(documents, table, remove="other")


# ---- language ID


def test_language_accuracy_on_held_out(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang").join(langid.op2_langid(docs), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


def test_language_of_awkward_texts(documents, empty, texts):
    out = by_id(langid.op2_langid(documents))
    for i, t in texts:
        has_letter = any(c.isalpha() for c in t or "")
        assert (out[i][1] == "und") == (not has_letter) and 0 <= out[i][2] <= 1
        assert out[i][0] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert langid.op2_langid(empty).count() == 0
    nothing = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.op2_langid(nothing).collect()} == {"und"}


def counted(texts, order=langid.ORDER):
    """language -> order -> n-gram (tuple of symbols) -> count, by dictionaries: the highest order's counts, below continuation counts."""
    grams = {}
    for lang, t in texts:
        s, _ = langid.encode([t])
        row = [0] * (order - 1) + s.tolist()
        for i in range(len(s)):
            g = tuple(row[i : i + order])
            held = grams.setdefault(lang, {order: {}})[order]
            held[g] = held.get(g, 0) + 1
    for held in grams.values():
        for o in range(order - 1, 0, -1):
            held[o] = {}
            for g in held[o + 1]:
                held[o][g[1:]] = held[o].get(g[1:], 0) + 1
    return grams


def plain_kneser_ney(texts, text, order=langid.ORDER):
    """Bits per symbol of a text in each language, letter by letter."""
    grams = counted(texts, order)
    alphabet = len({g for held in grams.values() for g in held[1]}) + 1
    out = {}
    for lang, held in grams.items():
        discount = {o: min(0.9, max(0.1, (n := list(held[o].values())).count(1) / max(1, n.count(1) + 2 * n.count(2)))) for o in held}

        def p(gram, held=held, discount=discount):
            if not gram:
                return 1 / alphabet
            o, followers = len(gram), {g: c for g, c in held[len(gram)].items() if g[:-1] == gram[:-1]}
            if not followers:
                return p(gram[1:])
            total = sum(followers.values())
            return max(followers.get(gram, 0) - discount[o], 0) / total + discount[o] * len(followers) / total * p(gram[1:])

        s, _ = langid.encode([text])
        row = [0] * (order - 1) + s.tolist()
        out[lang] = -sum(np.log2(p(tuple(row[i : i + order]))) for i in range(len(s))) / len(s)
    return out


LEARNED = [("x", "abab abba baba cab"), ("x", "aab bba abab"), ("y", "the old man and the sea, the sea"), ("y", "a man of the sea"), ("z", "größe über maß und muß"), ("z", "das große haus am see")]


@pytest.mark.parametrize("max_cells", [12_000_000, 60])
def test_scores_are_plain_kneser_ney(spark, max_cells):
    labelled = spark.createDataFrame(LEARNED, "lang string, text string")
    model = langid.train(labelled, max_cells=max_cells)
    assert (model.shares > 5) == (max_cells == 60)
    asked = ["abba cab", "the man", "große see", "qqq zzz", "the old größe baba"]
    rows = {r.text: r["__p"] for r in model.score(spark.createDataFrame([(t,) for t in [*asked, None, "12 ."]], "text string")).collect()}
    for t in asked:
        bits = plain_kneser_ney(LEARNED, t)
        assert rows[t].bits == pytest.approx(min(bits.values()), abs=1e-4) and rows[t].lang == min(sorted(bits), key=bits.get)
    assert rows[None].lang == rows["12 ."].lang == "und" and rows[None].rejected


def test_other_languages_are_rejected(spark, sf_dir):
    labelled = common.table(spark, sf_dir, "documents").select("lang", "text")
    model = langid.train(labelled)
    strange = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "いろはにほへとちりぬるを わかよたれそつねならむ " * 4, "xqzj kwvx qqzx jjkw vvxz qjxk " * 6]
    told = model.score(spark.createDataFrame([(t,) for t in strange], "text string")).collect()
    assert all(r["__p"].rejected for r in told)
    own = model.score(labelled.filter("lang IS NOT NULL AND length(text) > 20"))
    assert own.filter("__p.rejected").count() <= 0.01 * own.count()


def test_probabilities_sum_to_one():
    held = counted([("x", "abab abba baba"), ("x", "aab bba abab")])["x"]
    pack = lambda g: sum(c << langid.WIDTH * (len(g) - 1 - i) for i, c in enumerate(g))
    orders = {o: (np.zeros(len(g), int), np.array([pack(k) for k in g], np.uint64), np.array(list(g.values()))) for o, g in held.items()}
    symbols = np.array([k[0] for k in held[1]], np.uint64)
    share = langid.Share(orders, {(0, o): 0.5 for o in held}, 1, len(symbols) + 1)
    for context in (0, int(orders[4][1][0] >> np.uint64(15))):
        seen = (2.0 ** share._logs((np.uint64(context) << np.uint64(15)) | symbols, langid.ORDER)[:, 0]).sum()
        assert 0.5 < seen <= 1.0 + 1e-6  # the rest is what an unseen symbol gets
        assert seen + 2.0 ** share._logs(np.array([(context << 15) | 999], np.uint64), langid.ORDER)[0, 0] == pytest.approx(1.0, abs=1e-5)


def test_hashed_rows_are_found():
    keys = np.random.default_rng(0).integers(0, 1 << 60, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    table = langid.Hashed(keys, np.arange(len(keys))[:, None])
    assert (table.rows[table.find(keys), 0] == np.arange(len(keys))).all()
    assert (table.find(keys ^ np.uint64(1 << 61)) == -1).all()


# ---- token files


def test_tokens_are_brute_force(documents, texts, empty):
    assert by_id(tokenbin.op3_token_binary(documents)) == tokenbin.brute_force(texts)
    assert tokenbin.op3_token_binary(empty).count() == 0


def test_words_are_cut_only_where_the_library_does(spark):
    rng = np.random.default_rng(2)
    bits = ["a", "B", "é", " ", " ", "  ", "\n", "\n", ",", ".", "1", "²", "_", "'s", "\t", "\u00a0", "\x1c", "中", "x.", "<|endoftext|>", "\u0301", "٣", "don't", "...", "!", "\r\n", " word", " words,\nMore"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(1, 12)))) for i in range(4000)]
    assert by_id(tokenbin.op3_token_binary(spark.createDataFrame(rows, "doc_id long, text string"))) == tokenbin.brute_force(rows)


def test_special_tokens_as_the_plain_call(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "a <|endoftext| b")]
    out = by_id(tokenbin.op3_token_binary(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == tokenbin.brute_force(rows) and out[1][1] == 5


def test_a_small_memory_encodes_alike(texts, monkeypatch):
    want = tokenbin.brute_force(texts)
    monkeypatch.setattr(tokenbin, "GENERATION", 5)
    encoder = tokenbin.Encoder(tokenbin.vocabulary_path(), "<u2")
    for doc, text in texts:
        assert len(encoder.encode(text)) // 2 + 1 == want[doc][1] and len(encoder) <= 6 and len(encoder.old) <= 6


def test_token_files_in_memory(spark, documents, texts, tmp_path):
    manifest = tokenbin.write(documents, f"file://{tmp_path}/t", file_tokens=3000)
    assert manifest.count() > 3
    files, want = tokenbin.TokenFiles(f"file://{tmp_path}/t"), tokenbin.brute_force(texts)
    assert len(files) == len(texts)
    for i in range(len(files)):
        doc, ids = files[i]
        assert (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (i, *want[i][1:])
    start = want[7][0]
    assert (files.window(start, 5) == files[7][1][:5]).all() and len(files.window(0, 10**9)) == files.bases[-1]


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (5, "x"), (5, "y z"), (5, "x"), (1, None)]
    out = tokenbin.op3_token_binary(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 5, 5, 5] and [r.start for r in out][0] == 0


# ---- PII


PII = "Mrs. Anna Smith wrote to Anna.Smith@corp.org and anna.smith@corp.org from 10.2.3.4, call +1 (389) 555-5010 or +1 389 555 5010, card 4111 1111 1111 1111, id 123-45-6789. Mr Smith and господин Иван Петров agreed."


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [(1, PII, "k"), (2, "Again Mrs. Anna Smith, 10.2.3.4.", "k"), (3, None, "k"), (4, "", "k"), (5, "nothing here, 3.5 of 2020-01-02", "k"), (1, PII, "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = surrogates.replace_pii(table)
    assert out.columns[:3] == table.columns
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, r)
        assert found[r.doc_id].text == r.text
    text = found[1].text
    for secret in ("Anna", "Smith", "corp.org", "10.2.3.4", "389", "4111", "123-45", "Иван", "Петров"):
        assert secret not in text
    import re

    mails = re.findall(r"\S+@\S+", text)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()
    phones = re.findall(r"\+1[ \d()-]+\d", text)
    assert [re.sub(r"\D", "", p) for p in phones][0] == re.sub(r"\D", "", phones[1]) and "(" in phones[0] and "(" not in phones[1]
    card = re.search(r"card ([\d ]+\d)", text)[1].replace(" ", "")
    assert sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(card))) % 10 == 0
    first, last = re.search(r"^Mrs\. (\S+) (\S+)", text).groups()
    assert first in surrogates.GIVEN["f_latin"] and f"Mr {last} and" in text and f"Mrs. {first} {last}," in found[2].text
    assert re.search(r"господин [А-яё]+ [А-яё]+ agreed", text)
    assert found[3].text is None and found[4].text == "" and found[5].text == rows[4][1] and found[5].n_ip == 0


def test_secrets_after_keys_of_any_case(spark):
    secrets = ["9233A8ECF7C5AB01", "hunter2hunter2", "k3yk3yk3yk3y", "zz99zz99zz99"]
    rows = [(1, f'TOKEN = "{secrets[0]}" Password: {secrets[1]} API_KEY={secrets[2]} token = "{secrets[3]}"')]
    text = surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).first().text
    assert not any(s in text for s in secrets) and text.startswith('TOKEN = "') and " Password: " in text and " API_KEY=" in text


def test_surrogates_are_distinct(spark):
    rows = [(i, f"Mr. N{chr(97 + i % 26)}{chr(97 + i // 26)}m Xy{chr(97 + i % 26)}{chr(97 + i // 26)} and 10.0.{i // 250}.{i % 250}") for i in range(400)]
    out = surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [r.text.split()[2] for r in out]
    assert len(set(names)) == 400 and len({r.text.split()[-1] for r in out}) == 400
    assert not {r.text.split()[-1] for r in out} & {t.split()[-1] for _, t in rows}


def test_short_entities_run_out_of_no_surrogates(spark):
    hosts = ["com", "net", "org", "de", "fr", "es"]
    rows = [(i, f"{chr(97 + i % 26)}@{chr(97 + i // 26 % 26)}.{hosts[i // 676]}") for i in range(4056)]
    out = [r.text for r in surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(out)) == len(rows) and not set(out) & {t for _, t in rows}


def test_persons_are_one_wherever_they_stand(spark):
    rows = [(1, "Dr. Anna Smith met Mrs. Anna Smith. Smith left; Anna Smith stayed, with Anna's dog and Smith's card."), (2, "Prof. Anna Smith and Anna."), (3, "Smith and Anna, without a title"), (4, "Mr. Robin Lee and Mrs. Robin Lee; Robin Lee.")]
    out = {r.doc_id: r for r in surrogates.op4_pii_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    given, last = out[1].text.split()[1:3]
    assert given in surrogates.GIVEN["f_latin"] and set(last.split("-")) <= set(surrogates.SURNAMES["latin"])
    assert out[1].text == rows[0][1].replace("Anna", given).replace("Smith", last) and out[1].n_person == 6
    assert out[2].text == rows[1][1].replace("Anna", given).replace("Smith", last)
    assert out[3].text == rows[2][1] and out[3].n_entities == 0
    m, f, x = (out[4].text.split()[k] for k in (1, 5, 7))
    assert m in surrogates.GIVEN["m_latin"] and f in surrogates.GIVEN["f_latin"] and x in surrogates.GIVEN["x_latin"]


def test_surrogates_against_a_plain_search(spark, sf_dir):
    """Entities as another pattern engine finds them: what stands between stays, equal entities have equal surrogates, different ones different."""
    import regex

    find = regex.compile(surrogates.PATTERN.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    docs = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    out = {r.doc_id: r for r in surrogates.op4_pii_surrogates(common.table(spark, sf_dir, "documents")).collect()}
    forward, found = {}, 0
    for doc, text in docs.items():
        hits = [] if text is None else list(find.finditer(text))
        assert (out[doc].n_entities > 0) == bool(hits) and out[doc].n_entities >= len(hits)
        if not hits:
            assert out[doc].text == text
        elif out[doc].n_person == 0:  # names may stand without title as well
            edges = [0, *(p for h in hits for p in h.span()), len(text)]
            shape = "(.+?)".join(regex.escape(text[a:b]) for a, b in zip(edges[::2], edges[1::2]))
            whole = regex.fullmatch(shape, out[doc].text, regex.S)
            assert whole, doc
            for h, new in zip(hits, whole.groups()):
                found += 1
                assert new != h[0] and forward.setdefault(h[0], new) == new
    assert found > 5 and len(set(forward.values())) == len(forward)


def test_surrogates_of_nothing(empty, documents):
    assert surrogates.op4_pii_surrogates(empty).count() == 0
    same = documents.select("doc_id", F.col("text").alias("was")).join(surrogates.op4_pii_surrogates(documents), "doc_id")
    assert same.filter("n_entities = 0 AND NOT (was <=> text)").isEmpty()


def test_surrogates_run_no_python(documents):
    plan = surrogates.op4_pii_surrogates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- line dedup


def test_lines_are_brute_force(documents, texts, empty):
    assert by_id(linededup.op5_line_dedup(documents)) == linededup.brute_force(texts)
    assert linededup.op5_line_dedup(empty).count() == 0


def test_line_index_takes_batches_in_any_order(spark):
    line = "a line that is certainly long enough"
    batches = [[(1, line)], [(9, line + "\nother")], [(3, "x\n" + line.upper())], [(4, line)]]
    index = linededup.LineIndex(spark)
    for b in batches:
        index.add(spark.createDataFrame(b, "doc_id long, text string"))
    assert [r.keeper for r in index.dropped().collect()] == [9] and len(index.runs.levels) == 3
    index.close()


def test_repeated_ids_are_one_document(spark):
    line = "a line that is certainly long enough"
    rows = [(1, line), (1, line), (2, line), (None, line + "\nb")]
    out = linededup.op5_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 0)]


# ---- MPEG audio


def test_payload_survives(documents, texts, empty):
    import hashlib

    out = by_id(mpegaudio.op6_mpeg_audio(documents))
    for i, t in texts:
        raw = (t or "").encode()
        payload = mpegaudio.padded(raw)
        assert len(payload) % 64 == 0 < len(payload)
        assert out[i][:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert "crc=%d/0 skipped=0" % out[i][8] in out[i][6] and out[i][7] == out[i][8] * 36000
    assert mpegaudio.op6_mpeg_audio(empty).count() == 0


def test_payload_that_looks_like_a_tag_survives():
    for mark, back in ((b"TAG", 128), (b"APETAGEX", 32)):
        for n in range(192, 6400, 64):
            media = mpegaudio.store(b"x" * n)
            place = media.rindex(b"x") + 1 - (len(media) - back)  # payload bytes from the tag's place on
            if place < len(mark):
                continue
            raw = b"x" * (n - place) + mark + b"x" * (place - len(mark))
            media = mpegaudio.store(raw)
            assert media[len(media) - back :].startswith(mark)
            parsed = mpegaudio.parse(media)
            assert parsed["skipped"] == 0 and mpegaudio.payload_of(media, parsed) == (n, mpegaudio.padded(raw))
            tagged = mpegaudio.parse(media + b"TAG" + b"Title".ljust(125, b"\0"))
            assert tagged["skipped"] == 0 and ("id3v1:title", "Title") in tagged["tags"] and tagged["frames"] == parsed["frames"]
            break
        else:
            raise AssertionError("no text reaches the place of the tag")


def test_damage_is_skipped_and_seen():
    media = mpegaudio.store(b"payload" * 2100)
    whole = mpegaudio.parse(media)
    assert whole["table"] == "Xing" and whole["table_ok"] and whole["crc_bad"] == 0 and whole["variable"]
    noisy = b"\xff\xfb junk" + media[:300] + b"\xff\xfb\x00zz\xff" + media[300:] + b"TAG" + b"Title".ljust(125, b"\0")
    again = mpegaudio.parse(noisy)
    assert again["frames"] >= whole["frames"] - 1 and again["skipped"] > 0 and ("id3v1:title", "Title") in again["tags"]
    broken = bytearray(media)
    broken[whole["offsets"][1] + 10] ^= 1
    assert mpegaudio.parse(bytes(broken))["crc_bad"] == 1
    assert mpegaudio.parse(None) is None and mpegaudio.parse(b"")["frames"] == 0 and mpegaudio.parse(b"\xff" * 99)["frames"] == 0


def test_seek_offsets_are_frames():
    media = mpegaudio.store(bytes(range(1, 250)) * 40)
    for at in mpegaudio.parse(media)["offsets"]:
        assert mpegaudio.header(int.from_bytes(media[at : at + 4], "big"))


def test_other_layers_and_versions():
    word = 0xFFF3 << 16 | 8 << 12 | 0 << 10  # MPEG-2 layer III, 64 kbit/s, 22050 Hz
    version, layer, protected, bitrate, rate, _, length, samples = mpegaudio.header(word)
    assert (version, layer, protected, bitrate, rate, length, samples) == (2, 3, False, 64, 22050, 208, 576)
    stream = (word.to_bytes(4, "big") + bytes(204)) * 5
    assert mpegaudio.parse(stream)["samples"] == 5 * 576


def layer_two(alloc, scfsi, bitrate_index, mode=0, extension=0, flip=0):
    """A protected MPEG-1 layer II frame at 48 kHz whose allocations and selections are given as bit strings."""
    word = 0xFFFC << 16 | bitrate_index << 12 | 1 << 10 | mode << 6 | extension << 4
    h = mpegaudio.header(word)
    bits = alloc + scfsi
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    crc = 0xFFFF
    for b in f"{word & 0xFFFF:016b}" + bits:
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ int(b) else crc << 1) & 0xFFFF
    return (word.to_bytes(4, "big") + (crc ^ flip).to_bytes(2, "big") + body).ljust(h[6], b"\xa5")


def test_checksums_of_layers_one_and_two():
    widths = [4] * 11 + [3] * 12 + [2] * 4
    alloc, used = "", 0
    for k, w in enumerate(widths):  # two channels, 192 kbit/s
        for c in range(2):
            n = (k * 3 + c) % 3
            alloc, used = alloc + f"{n:0{w}b}", used + (n > 0)
    good, bad = layer_two(alloc, "01" * used, 10), layer_two(alloc, "01" * used, 10, flip=4)
    joint, shared = "", 0
    for k, w in enumerate(widths):  # joint stereo from subband 8 on
        for c in range(2 if k < 8 else 1):
            n = (k + c) % 2
            joint, shared = joint + f"{n:0{w}b}", shared + (n > 0) * (1 if k < 8 else 2)
    third = layer_two(joint, "10" * shared, 10, mode=1, extension=1)
    parsed = mpegaudio.parse(good * 3 + bad + third)
    assert (parsed["layer"], parsed["frames"], parsed["crc_good"], parsed["crc_bad"], parsed["samples"]) == (2, 5, 4, 1, 5 * 1152)
    word = 0xFFFE << 16 | 5 << 12 | 1 << 10 | 3 << 6  # layer I, one channel: 16 bytes of allocations
    body = bytes(range(16))
    frame = word.to_bytes(4, "big") + mpegaudio.crc16(word.to_bytes(4, "big")[2:] + body).to_bytes(2, "big") + body
    frame = frame.ljust(mpegaudio.header(word)[6], b"\x11")
    parsed = mpegaudio.parse(frame * 4)
    assert (parsed["layer"], parsed["crc_good"], parsed["crc_bad"], parsed["samples"]) == (1, 4, 0, 4 * 384)


def test_vbri_seek_table():
    import struct

    word = 0xFFFB << 16 | 9 << 12 | 1 << 10 | 1 << 6
    length, small = mpegaudio.header(word)[6], mpegaudio.header(0xFFFB << 16 | 5 << 12 | 1 << 10 | 1 << 6)[6]
    frames = [(word.to_bytes(4, "big")).ljust(length, b"\0") if k % 3 else (0xFFFB << 16 | 5 << 12 | 1 << 10 | 1 << 6).to_bytes(4, "big").ljust(small, b"\0") for k in range(12)]
    steps = [sum(map(len, frames[k : k + 4])) for k in range(0, 12, 4)]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, sum(map(len, frames)) + length, 12, 3, 1, 2, 4) + b"".join(struct.pack(">H", n) for n in steps)
    head = (word.to_bytes(4, "big") + bytes(32) + table).ljust(length, b"\0")
    parsed = mpegaudio.parse(head + b"".join(frames))
    assert parsed["table"] == "VBRI" and parsed["table_ok"] and parsed["frames"] == 12 and parsed["variable"]
    assert parsed["seek"] == [0, *np.cumsum(steps).tolist()] and len(parsed["seek"]) == 4
    wrong = head.replace(struct.pack(">H", steps[1]), struct.pack(">H", steps[1] + 999))
    assert not mpegaudio.parse(wrong + b"".join(frames))["table_ok"]
    xing = mpegaudio.parse(mpegaudio.store(b"payload" * 2100))
    assert len(xing["seek"]) == 100 and xing["seek"] == sorted(xing["seek"])


# ---- mixing


def test_mix_follows_targets(documents, texts, empty):
    rows = mixing.mix(documents)
    assert rows.columns[: len(documents.columns)] == documents.columns
    out = rows.collect()
    assert len(out) == len(texts) and all(0 <= r.copies <= 2 for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(documents.repartition(7)).collect()))
    assert mixing.op7_mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(documents).count() == sum(r.copies for r in out)


def test_targets_by_hand(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 0)]
    out = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    goal = 1.5 * 2010 - 20  # a is full at 20; b weighs 1, c weighs 2, and c is full at 2000
    assert out["a"] == 20 and out["c"] == pytest.approx(min(2000, goal * 2 / 3)) and out[None] == 0
    assert out["b"] == pytest.approx(goal - out["c"])


def test_mix_counts_words_near_targets(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    many = rows.withColumn("source", F.lit("one")).unionByName(rows.withColumn("source", F.lit("two"))).unionByName(rows.withColumn("source", F.lit("three")))
    for r in mixing.mix(many).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.06)


def test_each_source_comes_near_its_target(spark):
    rows = mixing.op7_mix(common.table(spark, "/root/testdata/sf0.1", "documents"))
    sources = common.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source")
    for r in rows.join(sources, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r.taken - r.target) <= max(r.largest, 0.02 * r.target)


# ---- SimHash


def test_near_duplicates_are_brute_force(documents, texts, empty):
    assert by_id(simhash.op8_simhash(documents)) == simhash.brute_force(texts)
    assert simhash.op8_simhash(empty).count() == 0


@pytest.mark.parametrize("crowd", [4096, 12])
@pytest.mark.parametrize("count", [None, 10_000_000])
def test_links_lose_nothing(spark, crowd, count):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:12].tolist():
        for _ in range(60):
            fps.add(x ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    fps = sorted(fps)
    table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    scratch = common.Scratch(spark, "test")
    edges = simhash.join_crowds(simhash.links(table, count or len(fps), crowd=crowd))
    root = {x: x for x in fps} | {r.node: r.root for r in simhash.components(edges, scratch).collect()}
    label = {x: x for x in fps}
    arr = np.array(fps, np.uint64)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[k] ^ arr[k + 1 :]) <= 2) + k + 1:
            a, b = sorted((find(x), find(fps[j])))
            label[b] = a
    assert root == {x: find(x) for x in fps}


def test_keep_one_of_each_group(documents, texts):
    kept = simhash.keep_one(documents, shingles=False)
    assert kept.columns == documents.columns
    want = {c for _, c in simhash.brute_force(texts).values()}
    assert {r.doc_id for r in kept.collect()} == want


def test_near_copies_by_shingles(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(words, 400)) for _ in range(30)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k, b in enumerate(base[:20]):  # three words of 400 changed: a similarity of about 0.93
        for at in rng.integers(0, 400, 3):
            b[at] = "changed"
        rows.append((100 + k, " ".join(b)))
    rows += [(200 + k, " ".join(b[:200] + list(rng.choice(words, 200)))) for k, b in enumerate(base)]  # a half in common
    many = list(rng.choice(words, 300))
    for k in range(700):  # more than are paired up
        copy = many.copy()
        copy[int(rng.integers(300))] = f"v{k}"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(5000, None), (5001, "")]
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [*range(30), *range(200, 230), 1000, 5000]


def edited(words, at, n, tag):
    """A text with ``n`` words from ``at`` on replaced by others: n + 4 shingles go and as many come."""
    return words[:at] + [f"{tag}-{k}" for k in range(n)] + words[at + n :]


def joined(spark, rows, **options):
    """Sets of marks that the shingle links join."""
    from arborix.llm import shinglelinks

    found = shinglelinks.links(spark.createDataFrame(rows, "mark long, text string"), common.Scratch(spark, "test"), **options).collect()
    texts = {m: t.encode() for m, t in rows}
    assert all(shinglelinks.jaccard(texts[r.a], texts[r.b]) >= 0.8 for r in found)
    label = {m: m for m in texts}
    for r in found:
        old, new = label[r.a], label[r.b]
        label = {m: new if v == old else v for m, v in label.items()}
    groups = {}
    for m, v in label.items():
        groups.setdefault(v, set()).add(m)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_links_of_a_whole_table_are_those_of_an_exact_join(spark):
    """TEST_RECALL_DIR: a larger table than the one that is always tried."""
    import os
    from collections import Counter

    from arborix.llm import shinglelinks

    table = common.table(spark, os.environ.get("TEST_RECALL_DIR", "/root/testdata/sf0.01"), "documents")
    rows = [tuple(r) for r in table.filter("text IS NOT NULL").select(F.xxhash64("text").alias("mark"), "text").distinct().collect()]
    sets = {m: h for m, t in rows if len(h := shinglelinks.shingle_hashes(t.encode()).tolist())}
    common_ness = Counter(x for h in sets.values() for x in h)
    index, label, links = {}, {m: m for m in sets}, 0
    for m, h in sets.items():
        h = sorted(h, key=lambda x: (common_ness[x], x))
        seen = set()
        for x in h[: len(h) - -(-4 * len(h) // 5) + 1]:  # texts at 0.8 share one of their rarest shingles
            for other in index.setdefault(x, []):
                if other not in seen:
                    seen.add(other)
                    a, b = set(h), set(sets[other])
                    if len(a & b) >= 0.8 * len(a | b):
                        links += 1
                        old, new = label[m], label[other]
                        if old != new:
                            label = {k: new if v == old else v for k, v in label.items()}
            index[x].append(m)
    groups = {}
    for m, v in label.items():
        groups.setdefault(v, set()).add(m)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert links and joined(spark, rows) == want


def test_a_failed_guess_hides_no_link(spark):
    rows, want = [], set()
    for g in range(12):  # 204 words, 200 shingles
        words = [f"g{g}w{k}" for k in range(204)]
        rows.append((g * 1000, " ".join(edited(words, 20, 15, "twin"))))  # 0.826 to the last one
        rows += [(g * 1000 + 1 + k, " ".join(edited(words, 5 + 4 * k, 20, f"d{k}"))) for k in range(40)]  # 0.786 to the last one
        rows.append((g * 1000 + 999, " ".join(words)))
        want.add(frozenset((g * 1000, g * 1000 + 999)))
    texts = dict(rows)
    from arborix.llm import shinglelinks

    assert shinglelinks.jaccard(texts[0].encode(), texts[999].encode()) >= 0.82
    assert max(shinglelinks.jaccard(texts[k].encode(), texts[999].encode()) for k in range(1, 41)) < 0.79
    found = joined(spark, rows)
    assert all(any(w <= f for f in found) for w in want)


def test_a_band_of_unlike_texts_takes_time_in_proportion():
    """What a text is compared with in the first pass has a bound, and each text is compared."""
    import pyarrow as pa

    from arborix.llm import shinglelinks

    rng, compared = np.random.default_rng(1), []
    held = shinglelinks.likeness
    shinglelinks.likeness = lambda low, fps, a, b: compared.append(len(a)) or np.zeros(len(a))
    try:
        for n in (4000, 16_000):
            compared.clear()
            low = rng.integers(0, 1 << 32, (n, shinglelinks.BINS), dtype=np.uint32)
            batches = [pa.record_batch([pa.array(np.zeros(400, np.int64)), pa.array(np.arange(k, k + 400)), pa.array(rng.integers(0, 1 << 62, 400)), pa.array([r.tobytes() for r in low[k : k + 400]], pa.binary())], names=["key", "mark", "fp", "low"]) for k in range(0, n, 400)]
            assert not list(shinglelinks.pair_up(0.7, 512)(iter(batches)))
            assert n * 500 < sum(compared) < n * 800
    finally:
        shinglelinks.likeness = held


def test_a_large_component_is_not_paired_with_itself(spark):
    """Hundreds of copies of one text, joined already, and some near copies that the first pass cannot see."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    rows = []
    for k in range(300):
        own = list(words)
        own[k % 300] = f"changed{k}"
        rows.append((k, " ".join(own)))
    others = [(1000 + k, " ".join(f"o{k}x{j}" for j in range(120))) for k in range(40)]
    assert joined(spark, rows + others, crowd=32) == {frozenset(range(300))}


def test_a_crowd_loses_no_link(spark):
    """Texts on one template, unlike one another but like the first in the share of minimum hashes; later ones are their near copies."""
    words, n = [f"w{k}" for k in range(204)], 1400
    rows = [(0, " ".join(words))]
    for k in range(n):
        own = edited(words, k * 7 % 180, 20, f"f{k}")  # 0.786 to the first
        rows.append((1 + k, " ".join(own)))
        if k % 4 == 0:
            rows.append((10_000 + k, " ".join([*own[:-1], f"end{k}"])))  # 0.99 to the other
    found = joined(spark, rows, crowd=64)
    where = {m: g for g in found for m in g}
    assert all(10_000 + k in where.get(1 + k, ()) for k in range(0, n, 4))


# ---- token counts


def test_counts_are_greedy(documents, texts, empty):
    pieces = set(wordpiece.load_pieces(wordpiece.vocabulary_path()))
    got = by_id(wordpiece.op9_token_counts(documents))
    for i, t in texts:
        assert got[i] == wordpiece.brute_force(t, pieces)
    assert wordpiece.op9_token_counts(empty).count() == 0


def test_failure_links_on_a_small_vocabulary():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pieces = {b" ", *(bytes([c]) for c in b"abcd")}
        pieces |= {bytes(rng.choice(list(b"abcd"), rng.integers(2, 7)).tolist()) for _ in range(8)}
        pieces |= {b" " + bytes(rng.choice(list(b"abcd"), rng.integers(1, 5)).tolist()) for _ in range(4)}
        a = wordpiece.Automaton(sorted(pieces))
        for _ in range(60):
            word = bytes(rng.choice(list(b"abcd"), rng.integers(1, 20)).tolist())
            assert a.text(word) == wordpiece.brute_force(word.decode(), pieces)
    with pytest.raises(ValueError):
        a.count(b"z")


# ---- suffix dedup


def as_rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_substrings_are_brute_force(documents, texts, empty):
    assert as_rows(suffixdedup.op10_suffix_dedup(documents)) == sorted(map(str, suffixdedup.brute_force(texts)))
    assert suffixdedup.op10_suffix_dedup(empty).count() == 0


def test_hard_substrings(spark):
    rng = np.random.default_rng(9)
    letters = list("abcdefgh ")
    base = ["".join(rng.choice(letters, 2500)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.integers(1, 4)):
            s = int(rng.integers(0, 2000))
            t += base[rng.integers(4)][s : s + int(rng.choice([399, 400, 401, 470, 900]))] + "".join(rng.choice(list("xyz"), rng.integers(0, 200)))
        rows.append((i, t))
    rows += [(90, "ab" * 700), (91, "a" * 399), (92, "a" * 401), (93, None), (94, ""), (95, rows[0][1]), (95, rows[0][1]), (96, "é" * 300), (None, rows[1][1])]
    out = suffixdedup.op10_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(out) == sorted(map(str, suffixdedup.brute_force(rows)))


@pytest.mark.parametrize("few", [32, 2])
def test_large_groups_of_variants(spark, few):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 500, 260)]
    rows = []
    for i in range(60):  # words changed, so that passages of every length are shared
        t = base.copy()
        for at in rng.integers(0, 260, 4):
            t[at] = f"other{i}"
        rows.append((i, " ".join(t) if i % 3 else "\n".join(t).upper()))
    rows += [(90, " ".join(base[:50])), (91, " ".join(base[:51])), (92, "x " * 500), (93, " ".join(base[20:200]).encode().decode() + " é")]
    marked = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffixdedup.dedup_substrings(marked, few=few).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256), "n_repeated_words", "left")
    assert as_rows(out) == sorted(map(str, suffixdedup.brute_force(rows)))


@pytest.mark.parametrize("piece", [1 << 17, 700])
def test_pieces_of_long_texts(monkeypatch, piece):
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    suffixdedup.powers.cache_clear()
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 9000, dtype=np.uint8))
    said = b" ".join(rng.choice([b"ab", b"c", b"d" * 30], 3000))
    for unit, symbols, size in ((suffixdedup.BYTES, text, len(text)), (suffixdedup.WORDS, said, 3000)):
        for k in unit.sizes:
            whole = list(suffixdedup.segments([b"", symbols, None, symbols, b"short"], unit, k))
            for number in (1, 3):
                covered = np.concatenate([np.arange(s, s + n) for row, a, b, *_ in whole for r, s, n in zip(row, a, b) if r == number])
                assert (covered == np.arange(size - unit.window + 1)).all()
            assert {r for row, *_ in whole for r in row} == {1, 3}
    suffixdedup.powers.cache_clear()


# ---- clashing names, repeated rows

CLASH = ["size", "copies", "target", "source_size", "held_out", "lang_pred", "score", "bits", "rejected", "n_words", "n_hit", "n_items", "items", "contaminated", "n_lines", "n_dropped", "kept", "n_tokens", "fp", "mark", "owner", "runs", "spans", "n_bytes", "n_removed", "known", "len", "n_email", "s", "c", "k", "a.b", "__s", "__c", "__hits", "__lose", "__id", "__mark", "__size", "__p", "__new", "__runs", "__copies"]


@pytest.fixture(scope="module")
def clashing(spark, documents):
    return documents.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def test_columns_of_the_same_name_pass_or_are_replaced(clashing, items):
    _, benchmark = items
    for out in (langid.accepted(clashing), simhash.keep_one(clashing), decontaminate.decontaminate(clashing, benchmark), mixing.mixed(clashing)):
        assert out.columns == clashing.columns
        for r in out.select([F.col(f"`{c}`") for c in CLASH]).distinct().collect():
            assert list(r) == [f"own {c}" for c in CLASH]
    for f in (langid.identify, mixing.mix, linededup.dedup_lines, wordpiece.with_counts, surrogates.replace_pii, suffixdedup.dedup_substrings, lambda d: decontaminate.measure(d, benchmark), mpegaudio.with_media):
        out = f(clashing)
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == clashing.count()


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "quite another text here", "z"), (None, "a b c d", "w"), (None, "only this one has no id", "v"), (2, None, "u"), (3, "", "t")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, tag string"))
    out = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert out == [(0, "only this one has no id"), (1, "a b c d"), (1, "quite another text here"), (2, "")]


def test_repeated_rows_in_every_operator(spark, documents, items):
    twice = documents.unionByName(documents)
    _, benchmark = items
    n = twice.count()
    for f in (lambda d: decontaminate.op1_decontaminate(d, benchmark), langid.op2_langid, tokenbin.op3_token_binary, surrogates.op4_pii_surrogates, linededup.op5_line_dedup, mpegaudio.op6_mpeg_audio, mixing.op7_mix, simhash.op8_simhash, wordpiece.op9_token_counts, suffixdedup.op10_suffix_dedup):
        assert f(twice).count() == n
