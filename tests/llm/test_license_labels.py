"""Licenses that differ by a word, notices inside other words, and planted copies of all templates."""

import random
import re

import pytest

from folio.llm import license_scan
from folio.llm.license_texts import TEMPLATES

DOCS = "doc_id long, text string, source string"
AROUND = "The paper was written in spring by the river and read in the town hall. "


def labels(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: (r.labels, r.score) for r in license_scan.scan(df).collect()}


def test_wordings_that_differ_by_a_word(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    notices = {
        cc.format(""): "cc-by", cc.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd", cc.format("-NonCommercial"): "cc-by-nc", cc.format("-ShareAlike"): "cc-by-sa",
        f"This program is free software: {gnu.format('')}": "gpl", f"This program is free software: {gnu.format('Affero ')}": "agpl,gpl", f"This program is free software: {gnu.format('Lesser ')}": "gpl,lgpl",
        "The paper was Released under the MIT dome in spring": "", "It was Released under the MIT License.": "mit", "Licensed under the Apache helicopters, Version 2.0": "",
        "Licensed under the Apache License, version 2.0": "apache-2.0", f"{cc.format('')} {AROUND * 4} {cc.format('-NonCommercial')}": "cc-by,cc-by-nc",
    }
    got = labels(spark, [AROUND + t + " " + AROUND for t in notices])
    # the base phrase of gpl stands in every notice of its family, and base labels stay
    assert {t: got[i][0] for i, t in enumerate(notices)} == notices


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_templates(spark, seed):
    """Copies of every template with a few words changed, put in or left out get their label and none besides base ones."""
    rng = random.Random(seed)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    texts, want = [], []
    for label, own in TEMPLATES.items():
        for text in own:
            w = words(text)
            if len(w) >= 30:
                keep = {"gnu", "general", "public", "license", "affero", "lesser", "attribution", "mozilla", "eclipse", "font", "boost", "apache", "mit"}
                for k in rng.sample(range(len(w)), len(w) // 25):
                    if w[k].lower() not in keep:
                        w[k] = rng.choice(["changed", "words", w[k] + " more"])
            filler = [f"x{rng.randrange(10**6)}" for _ in range(60)]
            texts.append(" ".join(filler[:30] + w + filler[30:]))
            lower = " ".join(x.lower() for x in words(texts[-1]))
            base = {name for phrase, name in license_scan.PHRASES.items() if f" {phrase} " in f" {lower} "}
            want.append((base, label))
    got = labels(spark, texts)
    shared = {"gpl", "lgpl", "agpl"}
    for i, (base, label) in enumerate(want):
        found = set(got[i][0].split(","))
        assert label in found or (label == "gpl" and found & shared), (texts[i], found)
        assert found <= base | {label} | (shared if label in shared else set()), (texts[i], found)


def test_many_notices_in_one_text(spark):
    notice = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. "
    got = labels(spark, [notice * 3000, (notice + AROUND * 30) * 200])
    assert got[0][0] == got[1][0] == "cc-by-nc" and got[1][1] == 1.0
