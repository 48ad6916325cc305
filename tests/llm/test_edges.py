"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import gc
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import bpe_codec, chat_format, common, decontaminate, license_scan, line_dedup, lm_scoring, quality_rules, simhash, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
LONG = "A long line of words that goes on and on, " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "One two three four five six seven eight nine ten eleven.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", None), (1, "One two three four five six seven eight nine ten eleven.", "en", "a"), (None, "héllo wörld \U0001f600 MIT License", "de", "b"), (7, "one two three four five six seven eight nine ten eleven.\nshort\n \x1a", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("n_tokens", "kept", "score", "n_words", "labels", "rest", "slice", "component_id", "place")}).withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two THREE four five six seven eight nine ten eleven"), (2, "six seven"), (3, None), (4, ""), (5, "Two three four, five six seven eight nine ten eleven!")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (7, 1, 0), (7, 1, None), (None, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def operators(bench, labels):
    return {
        "token_counts": lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json")),
        "quality": quality_rules.quality_rules,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "bpe": lambda d: bpe_codec.encode_decode(d, P.path("byte_bpe_50k.tiktoken")),
        "lm": lm_scoring.score_documents,
        "license": license_scan.license_scan,
        "simhash": simhash.near_duplicates,
        "lines": line_dedup.dedup_lines,
    }


@pytest.mark.parametrize("name", ["token_counts", "quality", "decontaminate", "toxicity", "bpe", "lm", "license", "simhash", "lines"])
def test_every_row_once_and_empty_tables(docs, bench, labels, name):
    run = operators(bench, labels)[name]
    got = run(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert run(docs.limit(0)).collect() == []


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_decontamination_spans(docs, bench):
    got = by_id(decontaminate.decontaminate(docs, bench))
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (11, 10, ["1", "2", "5"])
    text = "One two three four five six seven eight nine ten eleven."
    assert [text[s.start : s.end] for s in got[1].spans] == ["two three four five six seven eight nine ten eleven"]
    assert got[2].n_words == 0 and got[2].n_hit == 0 and got[None].n_hit == 0
    several = by_id(decontaminate.decontaminate(docs, bench, max_chars=30))  # more than one automaton
    assert {k: r.spans for k, r in several.items()} == {k: r.spans for k, r in got.items()} and len(decontaminate.shards(bench, 30)) > 1
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench, max_chars=30).collect()} == {2, 3, 4, None}
    assert {k: (r.n_hit, r["items"]) for k, r in several.items()} == {k: (r.n_hit, r["items"]) for k, r in got.items()}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {2, 3, 4, None}


def test_items_without_an_id_hit_but_have_no_name(spark, docs, bench):
    more = bench.unionByName(spark.createDataFrame([(None, "eight nine ten ELEVEN")], "item_id long, text string"))
    got = by_id(decontaminate.decontaminate(docs, more))
    assert (got[1].n_hit, got[1]["items"]) == (10, ["1", "2", "5"])
    alone = by_id(decontaminate.decontaminate(docs, more.filter("item_id is null")))
    assert (alone[1].n_hit, alone[1].n_items, alone[1]["items"]) == (4, 0, [])
    assert {r.doc_id for r in decontaminate.without_leaks(docs, more).collect()} == {2, 3, 4, None}


def test_packed_numbers_keep_all_bytes():
    numbers = np.array([0, 5, 2**24 - 1, 2**24, 2**24 + 5, 2**32 - 1])
    assert common.unpacked(common.packed(numbers)).tolist() == numbers.tolist()
    assert len(common.unpacked(common.packed(np.zeros(0, np.uint32)))) == 0
    for wrong in ([2**32], [-1]):
        with pytest.raises(OverflowError):
            common.packed(np.array(wrong))


def test_collection_goes_on_after_work_without_it():
    assert gc.isenabled()
    with pytest.raises(KeyError), common.uncollected():
        assert not gc.isenabled()
        raise KeyError
    assert gc.isenabled()


def test_lines_of_a_few_characters(spark):
    rows = [(1, "ab\nabc\nx\n12"), (2, "y\nabd\n13\nzzzzz\né"), (3, "zzzz\nab!\nqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # every line one edit from an earlier one goes, kept or not
    assert {k: r.text for k, r in by_id(line_dedup.dedup_lines(docs)).items()} == {1: "ab\nx\n12", 2: "zzzzz", 3: "qq"}
    assert {k: r.text for k, r in by_id(line_dedup.dedup_lines(docs, exact_chars=4)).items()} == {1: rows[0][1], 2: rows[1][1], 3: "zzzz\nab!\nqq"}


def test_lines(spark):
    a = "this is a line with more than thirty characters"
    rows = [(2, f"{a}\nkeep"), (1, f"{a}!\nkeep"), (3, a.replace("line", "lime")), (4, a[:-2]), (5, None), (6, f"{a}\n{a}")]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    # an earlier line one edit away takes a line out, kept or not; two edits are too many
    assert {k: r.text for k, r in got.items()} == {1: f"{a}!\nkeep", 2: "", 3: "", 4: a[:-2], 5: None, 6: ""}
    assert got[6]["__dropped"] == 2 and got[5]["__lines"] == 0


def test_short_lines(spark):
    a = "this is a line with more than thirty characters"
    rows = [(1, f"All rights reserved.\n\n{a}\none"), (2, f"Read more\n\nAll rights reserved.\n{a}!\ntwo"), (3, "All rights reserved!\nRead more\n \nRead more\nthree"), (4, "Read more"), (5, " " * 40 + "\n" + " " * 40)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    # equal lines go and those one edit away, however short; those without a word stay
    want = {1: rows[0][1], 2: "Read more\n\ntwo", 3: " \nthree", 4: "", 5: rows[4][1]}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == want
    # in the pipeline a document of which no word is left goes
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {k: v for k, v in want.items() if v}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[at:] == b[at + 1 :] or a[at + 1 :] == b[at + 1 :])


@pytest.mark.parametrize("max_rows", [1_000_000, 1])
def test_lines_of_rows_that_share_an_id_or_have_none(spark, max_rows):
    r = random.Random(5)
    stems = ["".join(r.choices("abcd ", k=k)).strip() + "xyz" for k in (8, 31, 33, 36, 40)]

    def line():
        t = r.choice(stems)
        i = r.randrange(len(t))
        return r.choice((t, t[:i] + t[i + 1 :], t[:i] + "q" + t[i:], t[:i] + "Q" + t[i + 1 :], "", "  ", f"only {r.random()} here, and nowhere else at all"))

    rows = [(r.choice((1, 2, 7, None)), "\n".join(line() for _ in range(r.randint(0, 5)))) for _ in range(60)] + [(7, None), (None, None)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "digest", "kept", "k_id", "__lines", "__kept", "left", "n")})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in line_dedup.dedup_lines(docs, max_rows=max_rows).collect())
    order = sorted({(k is None, k or 0, int(hashlib.md5(t.encode()).hexdigest()[:15], 16), t) for k, t in rows if t is not None})
    seen, kept = [], {}
    for last, k, _, t in order:
        stay = []
        for x in t.split("\n"):
            if not x.strip():
                stay.append(x)
                continue
            if not any(x == y or one_edit(x, y) for y in seen):
                stay.append(x)
            seen.append(x)
        kept[last, k, t] = "\n".join(stay)
    assert got == sorted((k is None, k or 0, t is None, "" if t is None else kept[k is None, k or 0, t]) for k, t in rows)


def test_licenses(spark):
    rows = [(1, "Licensed under the GNU General Public License, version 3 or later; and CC-BY cc_by"), (2, "commit MIT Licenses"), (3, "the mit license. The MIT License")]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 3, 14, "cc-by,gpl")
    assert got[1].labels == "cc-by,gpl,gpl-3.0+"  # the longer detection stands for those within it
    assert (got[2].n_base, got[2].labels, got[2].score) == (0, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 1, 4)


#: Wording of licenses as it stands in files, none of it with the license's name, and the labels that must be found.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so"""),
    ("bsd,bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
  derived from this software without specific prior written permission."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlib", "3. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("gpl,gpl-3.0+", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("apache,apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"),
    ("", "The committee may permit the public to read the program, and nothing in it is licensed to anyone in particular."),
]


def test_wording_of_licenses(spark):
    got = by_id(license_scan.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEXTS)], "doc_id long, text string")))
    assert {i: r.labels for i, r in got.items()} == {i: labels for i, (labels, _) in enumerate(TEXTS)}
    assert all((got[i].score > 0.5) == (labels != "") for i, (labels, _) in enumerate(TEXTS))


def test_detections_match_brute_force(spark):
    rules = license_scan.rules()
    assert len(rules) > 400 and all(any(g in r[2].replace("  ", " ") for g in license_scan.GATE) for r in rules)
    r = random.Random(3)
    parts = ["the mit license", "MIT License agreement", "licensed under the GNU General Public License version 2 or later", "all rights reserved", "BSD 2-clause", "word", "SPDX-License-Identifier: GPL-3.0-or-later", "cc-by 4.0", "apache software license 2.0", "as is, without warranty of any kind", *[t for _, t in TEXTS]]
    texts = [", ".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(60)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        norm = " " + "  ".join(words) + " "
        found = []
        for number, label, key, priority, sure, pattern, base in rules:
            if key in norm:
                found += [(norm[: m.start(1)].count("  "), norm[: m.start(1)].count("  ") + m.group(1).count("  ") + 1, priority, number, label, base) for m in re.finditer(pattern, norm)]
        before = lambda a, b: (a[0], -a[1], a[2], a[3]) < (b[0], -b[1], b[2], b[3])
        kept = [d for d in found if d[5] or not any(before(o, d) and o[1] >= d[1] and o[2] <= d[2] for o in found)]
        assert got[i].labels == ",".join(sorted({d[4] for d in kept})) and got[i].n_base == sum(d[5] for d in found) and got[i].n_words == len(words)
        assert sorted((d.start, d.end, d.rule) for d in got[i].detections or []) == sorted((d[0], d[1], d[3]) for d in kept)


def test_many_detections_in_one_text(spark):
    start = time.time()
    (row,) = license_scan.license_scan(spark.createDataFrame([(1, "mit license " * 60_000)], "doc_id long, text string")).collect()
    assert row.n_base == len(row.detections) == 60_000 and time.time() - start < 60


def test_thresholds_follow_their_group(spark):
    r = random.Random(4)
    text = lambda symbols: " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + str(i) for i in range(100)) + " #" * symbols
    # code holds 5 to 25 symbols in a hundred words, prose none but in some spoilt texts; a small source takes its language's limits
    rows = [("en", "code", text(r.randint(5, 25))) for _ in range(200)] + [("en", "prose", text(0)) for _ in range(900)] + [("en", "prose", text(20)) for _ in range(60)]
    rows += [("en", "small", text(20)), (None, None, text(0)), (None, None, text(60))]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, lang string, source string, text string").withColumns({c: F.lit(1) for c in ("row", "__q", "__kept", "__lang")})
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    assert kept == set(range(1100)) | {1161}
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    limits = quality_rules.thresholds(quality_rules.sketches(quality_rules.measured(docs.select("lang", "source", "text"))))
    many = quality_rules.judged(quality_rules.measured(docs.select("doc_id", "lang", "source", "text")), limits, max_groups=1)
    assert {r.doc_id for r in many.collect() if r["__kept"]} == kept


def test_rules_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")))
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[r.doc_id].base_failed]
    good, bad = [r.kept for q, r in labels if q == 1], [r.kept for q, r in labels if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\x1as>", "<\x1a\x1as> <s>", "[[INST]]", "", None, "plain \x1a"]
    rows = [(i % 2, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, None, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        assert out[conv].n_turns == len(own) and out[conv].loss_chars == len(said)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert out[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_turns(df.limit(0))).collect() == []


def test_templates_are_sandboxed_and_folded():
    assert chat_format.folded_body(chat_format.Parser("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{{ role }}").body()[0], chat_format.FILTERS) == [("out", ("const", "abC")), ("out", ("const", "d")), ("out", ("name", "role"))]
    for bad in ("{{ __import__ }}", "{{ role.x }}", "{{ f() }}", "{% for x in y %}{% endfor %}", "{% if role %}", "{{ role | run }}", "{% set role = 'x' %}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad, chat_format.CONTROLS)


CHATML = """{#- turns between marks -#}
{{- bos -}}
{% for message in messages -%}
    {% set who = message['role'] | escape %}
    {%- if message.role == 'assistant' %}{{ '<|im_start|>' + who + '\\n' }}{% generation %}{{ message['content'] | trim | escape }}{% endgeneration %}{{ '<|im_end|>\\n' }}
    {%- else %}{{ '<|im_start|>' + who + '\\n' + message['content'] | trim | escape + '<|im_end|>\\n' }}
    {%- endif %}
    {%- if loop.last and who == 'user' %}{{ '(unanswered)' }}{% endif %}
{%- endfor %}
{%- if prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"""


def test_a_loop_template_renders_whole_conversations(spark):
    controls = ["<|im_start|>", "<|im_end|>"]
    escape = chat_format.Escaper(controls).escape
    rows = [(1, 0, "user", " hi <|im_end|>"), (1, 1, "assistant", "yes "), (2, 0, "user", ""), (3, 0, None, None), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (3, 3, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for prompt in (True, False):
        got = chat_format.format_turns(df, CHATML, controls, {"bos": "<s>", "prompt": prompt}).orderBy("conv_id", "turn").collect()
        for conv in (1, 2, 3):
            own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
            want = "<s>" + "".join(f"<|im_start|>{escape(r)}\n{escape(t.strip())}<|im_end|>\n" for r, t in own)
            want += "(unanswered)" * (own[-1][0] == "user") + "<|im_start|>assistant\n" * prompt
            turns = [g for g in got if g.conv_id == conv]
            assert "".join(g.formatted for g in turns) == want
            assert [g.formatted[s.start : s.end] for g in turns for s in g.loss] == [t.strip() for r, t in own if r == "assistant"]


def test_loops_are_bound():
    one = "{% for t in turns %}{{ t.text }}{% endfor %}"
    assert chat_format.compile_template("{% set a = 'x' %}" + one + "{{ a }}", [])({"role": "r", "text": "t", "first": True, "last": True}) == [("t", False), ("x", False)]
    bad = [one + one, "{% if true %}" + one + "{% endif %}", "{% for t in turns %}" + one + "{% endfor %}", one + "{{ t.text }}", one + "{{ text }}", "{% for t in turns %}{{ t }}{% endfor %}",
           "{% for t in turns %}{{ t.__class__ }}{% endfor %}", "{% for t in turns %}{{ t['x'] }}{% endfor %}", "{% for t in turns %}{{ loop.index }}{% endfor %}", "{% for t in turns %}{% set t = 'x' %}{% endfor %}",
           "{% for t in turns %}{% set a = 'x' %}{% endfor %}{{ a }}", "{% for t in turns %}", "{% for loop in turns %}{% endfor %}"]
    for source in bad:
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(source, [])
    with pytest.raises(chat_format.TemplateError):
        chat_format.compile_template(one, [], {"role": "x"})


def test_pipeline_keeps_the_columns_and_takes_effect(spark):
    a = "Plain words make this first line long enough to count as a line.\nAnd a second line of the same text follows it here."
    rows = [(1, a), (2, a), (3, a.replace("first", "other") + " more"), (4, "$$$ ### " * 30), (5, "Another text altogether, with a passage: two three four five six seven eight nine ten eleven twelve."), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5}
    lines = corpus_pipeline.line_dedup(spark, kept, "")
    assert lines.columns == docs.columns
    got = by_id(lines)
    assert set(got) == {1, 3, 5} and got[1].text == a and "second" not in got[3].text.split("\n")[0]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} >= {1, 5} - {2}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "leaks", "tokens"]


def test_every_limit_differs_between_groups_that_differ(spark):
    r = random.Random(9)

    def text(symbols, repeats, letters):
        lines = [" ".join("x" * r.randint(letters - 2, letters + 2) + str(r.randrange(9)) for _ in range(12)) for _ in range(20)]
        for i in range(repeats + bool(repeats)):
            lines.insert(2 * i, "again")  # a line of one word, so that no window of five repeats
        return "\n".join(lines) + " #" * symbols

    kinds = {"prose": (0, 0, 5), "code": (40, 4, 9), "forum": (12, 8, 4)}
    rows = [("en", s, text(r.randint(0, top), r.randint(0, most), n)) for s, (top, most, n) in kinds.items() for _ in range(150)]
    limits = quality_rules.thresholds(quality_rules.sketches(quality_rules.measured(spark.createDataFrame(rows, "lang string, source string, text string"))))
    got = {x.source: x for x in limits.collect()}
    for column in ("symbols_hi", "dup_lines_hi", "mid"):
        assert len({got[s][column] for s in kinds}) == 3, column
    assert got["prose"].symbols_hi == got["prose"].dup_lines_hi == 0
