"""Line dedup, near dedup, chat formatting and licence scan against plain Python."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from folioframe.llm.chat import Template, format_chats, read_back, unescape
from folioframe.llm.components import connected_components
from folioframe.llm.licences import LICENCE_TEXTS, _bigrams, _telling_words, licence_sql, scan_licences
from folioframe.llm.line_dedup import remove_repeated_lines
from folioframe.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_lines string, k1 string, lines string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOCS)


def model_line_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if w in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(w)
        out[i] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(lines), len(gone))
    return out


def test_line_dedup_on_random_documents(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(80)]
    out = remove_repeated_lines(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "k1", "lines", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == model_line_dedup(rows)


def test_line_dedup_edges(spark):
    long = "\n".join(str(i) for i in range(20000))
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, ""), (4, "x\ny"), (5, long), (6, long), (7, "a\na\na\na"), (8, "q\nr\ns"), (8, "q\nr\ns")]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in remove_repeated_lines(docs(spark, rows)).collect()), key=str)
    by = {k: [x[1:] for x in got if x[0] == k] for k in (None, 1, 2, 3, 4, 5, 6, 7, 8)}
    assert by[None] == [("a\nb\nc", 3, 0)] and by[1] == [("", 3, 3)]
    assert by[2] == [(None, 0, 0)] and by[3] == [("", 1, 0)] and by[4] == [("x\ny", 2, 0)]
    assert by[5] == [(long, 20000, 0)] and by[6] == [("", 20000, 20000)]
    assert by[7] == [("a", 4, 3)]
    assert by[8] == [("q\nr\ns", 3, 0)] * 2
    assert remove_repeated_lines(docs(spark, [])).count() == 0


def plain_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return bits - 2**64 if bits >= 2**63 else bits


def test_fingerprint():
    for text in ("", None, "One", "A b", "É ß Ö x y", "the a b\tc\nd " * 9, "w " * 40000, "\x0b\x0c \r"):
        if text and "\x0b" in text:
            assert fingerprint(text) == 0
        else:
            assert fingerprint(text) == plain_fingerprint(text)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 60)
    prints = {int(x) for x in base}
    for x in base[:40]:
        for _ in range(6):
            y = int(x) & (2**64 - 1)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(b)
            prints.add(y - 2**64 if y >= 2**63 else y)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {(r.a, r.b) for r in fingerprint_links(df).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for segments in (1, 2, 4, 8):
        assert got == {(r.a, r.b) for r in fingerprint_links(df, segments=segments).collect()}


def test_components(spark):
    rng, edges = random.Random(4), [(i, i + 1) for i in range(1, 40)]
    edges += [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b and x != y:
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in connected_components(df).collect()} == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    assert connected_components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (3, text), (9, text.replace("w7 ", "q7 ")), (1, None), (2, ""), (4, " \t"), (None, "other words here"), (None, "quite different things now"), (6, "A b c"), (7, "a B c")]
    given = docs(spark, rows)
    got = [(r.doc_id, r.component_id) for r in near_duplicates(given).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[5] == by[3] == 3 and by[1] == by[2] == by[4] == 1 and by[6] == by[7] == 6 and by[None] is None
    near = bin((fingerprint(text) ^ fingerprint(rows[3][1])) & (2**64 - 1)).count("1") <= 2
    assert by[9] == (3 if near else 9)
    kept = drop_near_duplicates(given)
    assert kept.columns == given.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([3, 1, None, None, 6] + ([] if near else [9]), key=str)
    assert drop_near_duplicates(given.limit(0)).count() == 0


def test_near_dedup_stage_joins_edited_copies(spark):
    import corpus_pipeline

    rng, rows = random.Random(12), [(900, None), (901, ""), (902, " "), (903, "a b"), (904, "A b"), (905, "a c")]
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 60, 120, 400]))]
        for k in range(4):
            edited = list(words)
            for at in rng.sample(range(len(words)), min(len(words), rng.randrange(0, len(words) // 25 + 2))):
                edited[at] = f"edit{g}x{k}x{at}"
            rows.append((g * 4 + k, " ".join(edited)))
    sets = {i: frozenset(tuple(w[at : at + 5]) for at in range(max(1, len(w) - 4))) for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    given = docs(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, given, "")
    assert kept.columns == given.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in sets})
    assert 40 < len({find(i) for i in sets}) < 150


CHAT = "conv_id long, turn long, role string, text string, turns string"


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[INST", "<s></s>", "", " x ", "[/TURN][ROLE] a [/ROLE]", "\\n\\\\", "[SYS] a [/SYS]", "<\\/s>", "a\nb", None]
    roles = ["user", "assistant", "system", "tool", "[INST] odd", None]
    rng = random.Random(7)
    rows = [(c if c else None, t, rng.choice(roles), rng.choice(nasty), "clash") for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(99, 0, "system", "s", ""), (99, 1, "user", "u", ""), (99, 2, "assistant", "a", ""), (98, 0, "user", "u", ""), (98, 1, "user", "v", "")]
    out = format_chats(spark.createDataFrame(rows, CHAT))
    read = out.select("conv_id", "n_turns", "valid", "first_invalid", "segments", "formatted", read_back(F.col("formatted"), Template()).alias("turns"),
                      F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("loss")).collect()
    for r in read:
        want = [(role or "", text or "") for _, _, role, text in sorted(((x[0], x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id), key=lambda x: x[1:])]
        assert [(t.role, t.text) for t in r.turns] == want and r.n_turns == len(want)
        assert list(r.loss) == [t for role, t in want if role == "assistant"]
        assert "".join(s.text for s in r.segments) == r.formatted
    by = {r.conv_id: r for r in read}
    assert by[99].valid and by[99].first_invalid is None and not by[98].valid and by[98].first_invalid == 1
    assert format_chats(spark.createDataFrame([], CHAT)).count() == 0


CHATML = dict(begin="<|begin|>", roles={r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")})


def test_chatml_reads_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok<|im_end|>", "<|im_start|>user", "\\", "\n", " <|begin|> ", "", "<", "plain"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)], "clash") for c in range(16) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "tool"])]
    template = Template(**CHATML)
    out = format_chats(spark.createDataFrame(rows, CHAT), template).select("conv_id", read_back(F.col("formatted"), template).alias("turns"))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for c, _, role, text, _ in rows if c == r.conv_id]


def test_templates_that_could_not_be_read_back():
    same = {"user": ("<u>", "</t>"), "assistant": ("<u>", "</t>")}
    blank, short, endless = {"user": (" ", "</t>")}, {"user": ("#", "</t>")}, {"user": ("<u>", "")}
    stop, inner, back = {"user": ("</t>", "</u>"), "assistant": ("", "</t>")}, {"user": ("abc", "bcd")}, {"user": ("<\\u>", "</t>")}
    for roles in (same, blank, short, endless, stop, inner, back):
        with pytest.raises(ValueError):
            Template(roles=roles)
    Template(), Template(**CHATML)


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under\n\nthe Apache License, version 2.0 !"), (3, None), (4, ""), (5, "mit " * 50000), (6, "This program is free software: you can redistribute it and/or modify it under the\nterms of the GNU General Public License as published by the Free Software Foundation,\neither version 3 of the License, or (at your option) any later version."), (7, "Released under the MIT."), (None, "Licensed under CC BY-NC 4.0.")]
    got = sorted(((r.doc_id, r.unit, r.pos, r.licence, round(r.dice, 3)) for r in scan_licences(docs(spark, rows)).collect()), key=str)
    assert (1, "line", 1, "MIT", 1.0) in got and (6, "paragraph", 0, "GPL-3.0-header", 1.0) in got and (None, "line", 0, "CC-BY-NC-4.0", 1.0) in got
    assert not [x for x in got if x[0] in (3, 4, 5)]
    assert scan_licences(docs(spark, [])).count() == 0


def test_licences_agree_with_sql(spark):
    import duckdb

    rng, rows = random.Random(21), ["ce texte released under the mit license", "Intro. This tool is small. Released under the MIT License. See the docs for more.", "SPDX-License-Identifier: Apache-2.0", "x = 1  # SPDX-License-Identifier: GPL-2.0-or-later",
            "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "mit license mit license mit license released under the", "the mit license mit the mit license mit", "", None, "license", "Released under the MIT"]
    header = LICENCE_TEXTS["Apache-2.0-header"]
    rows += [header.replace("You may obtain", "\n\nYou may obtain").replace("Unless", "\n\nUnless"), "Words before it. " + header + " And after.", "/* " + LICENCE_TEXTS["MIT-full"].replace(". ", ".\n * ") + " */"]
    # Units on and next to each bound, and copies with words dropped, put in and replaced.
    for name in ("MIT", "CC-BY-4.0", "BSD-notice", "ISC", "MIT-title"):
        words = LICENCE_TEXTS[name].split()
        for extra in range(len(words) // 2 + 3):
            rows += [" ".join(f"q{i}" for i in range(extra)) + " " + " ".join(words), " ".join(words[extra:]), "some text before " + " ".join(words[: len(words) - extra])]
        for _ in range(6):
            rows.append(" ".join(w if rng.random() < 0.85 else rng.choice(["", w + " " + w, "other"]) for w in words * 2))
    given = docs(spark, list(enumerate(rows)))
    got = sorted((r.doc_id, r.unit, r.pos, r.licence, round(r.dice, 12)) for r in scan_licences(given).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
    assert got == sorted((*r[:4], round(r[4], 12)) for r in con.execute(licence_sql()).fetchall())
    by = {}
    for r in got:
        by.setdefault(r[0], set()).add((r[1], r[3]))
    assert ("line", "MIT") in by[0] and ("passage", "MIT") in by[1] and ("line", "SPDX-Apache-2.0") in by[2] and ("passage", "SPDX-GPL-2.0-or-later") in by[3]
    assert ("paragraph", "LGPL-3.0-title") in by[4] and not {7, 8, 9} & by.keys()
    assert ("document", "Apache-2.0-header") in by[11] and ("passage", "Apache-2.0-header") in by[12] and ("passage", "MIT-full") in by[13]
    assert any(r[4] == 0.8 for r in got) and len(LICENCE_TEXTS) >= 30


def test_telling_words_cover_every_unit_that_can_reach_the_threshold():
    from fractions import Fraction

    rng = random.Random(3)
    for text in LICENCE_TEXTS.values():
        bag, telling = _bigrams(text), _telling_words(text, Fraction(2, 3))
        for _ in range(50):
            kept = rng.sample(sorted(bag), -(-len(bag) * 2 // 3))
            assert telling.intersection(" ".join(kept).split())


def test_hash_helper_matches_spark(spark):
    text = "Some Ünïcode text"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(text, 42)
    assert hashlib.sha256(b"").hexdigest()
