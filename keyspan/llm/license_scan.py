"""License scans by diagonal voting, in DataFrame expressions only.

All word 3-grams of a document meet the 3-grams of license texts in a join on their hash (checked on
the words).  Each meeting votes for the diagonal document place - template place; neighbouring
diagonals of a template are merged, so a word put in or left out doesn't end a match, and a span is
accepted by how much of its template it covers and how long it is, if it has the words that tell its
license from others of like wording and none of theirs.  Phrases must be covered wholly on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .native import each_run, folded_words, let

K = 3
# Phrases that name a license, and the clauses and short notices that license texts are known by, as lower-case words.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non commercial 4 0 international license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu gpl version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "licensed under the gnu lgpl version 3"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
)
#: 3-grams that a span must have if its template has them.
REQUIRED = {
    "apache-2": ("the apache license",), "mpl-2": ("mozilla public license",), "epl-2": ("eclipse public license",),
    "cc-by-sa": ("commons attribution sharealike", "attribution share alike"), "cc-by-nc": ("commons attribution noncommercial", "attribution non commercial"),
}
#: 3-grams of other licenses that a span must not have; they count from where their first word stands in the template.
_MORE = ("sharealike", "share", "noderivatives", "noderivs", "no")
VETOES = {
    "gpl": ("gnu lesser general", "gnu affero general", "gnu library general", "gnu lesser gpl", "gnu affero gpl", "gnu library gpl", "the gnu lgpl", "the gnu agpl"),
    "lgpl": ("gnu general public", "gnu affero general", "gnu affero gpl", "the gnu gpl", "the gnu agpl"),
    "cc-by": tuple(f"commons attribution {w}" for w in (*_MORE, "noncommercial", "non")),
    "cc-by-sa": (), "cc-by-nc": tuple(f"{a} {w}" for a in ("attribution noncommercial", "non commercial") for w in _MORE),
}
#: Least share of a template's 3-grams, widest diagonal step that is merged, longest span against the template.
COVER, STEP, STRETCH = 0.6, 3, 1.5
#: Words of all templates at most, as their 3-grams are broadcast (about 100 bytes each).
TEMPLATE_WORDS = 200_000


def template_grams(spark, phrases, templates) -> DataFrame:
    """(label, template, phrase, grams, needs, place, known, need, veto): a fixed table of the given texts and their vetoes."""
    rows = []
    for number, (label, text, phrase) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in templates]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words or more: {text!r}")
        known = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        need = [not phrase and g in REQUIRED.get(label, ()) for g in known]
        head = (label, number, phrase, len(known), sum(need))
        rows += [(*head, i, g, n, False) for i, (g, n) in enumerate(zip(known, need, strict=True))]
        if not phrase:
            for g in VETOES.get(label, ()):
                pair = g.split()[:2]
                at = next((i for i in range(len(words)) if words[i : i + 2] == pair), words.index(pair[0]) if pair[0] in words else None)
                rows += [(*head, at, g, False, True)] if at is not None else []
    return spark.createDataFrame(rows, "label string, template int, phrase boolean, grams int, needs int, place int, known string, need boolean, veto boolean").withColumn("h", F.xxhash64("known"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.  Broadcasts `templates`, which must stay
    below TEMPLATE_WORDS words.

    base columns come from phrases alone; labels adds accepted templates; score is the best cover of any label, 0 without one.
    Null and empty texts have no words and no labels.  Rows are told apart by id and text hash: repeated rows stay.
    One pass over the texts: a row without 3-gram for each document, and one for each 3-gram that a template has, are shuffled.
    """
    spark = docs.sparkSession
    if sum(len(t.split()) for _, t in (*phrases, *templates)) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words are too much to broadcast")
    known = F.broadcast(template_grams(spark, phrases, templates))  # as many rows as the given texts have words
    text = lambda w: F.coalesce(each_run(w, K, lambda i: F.array_join(F.slice(w, i, K), " ")), F.array().cast("array<string>"))
    own = let(folded_words(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), F.concat(F.array(F.lit(None).cast("string")), text(w)).alias("grams")))
    scanned = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), own.alias("o")).select("id", "th", F.col("o.n").alias("n"), F.posexplode("o.grams").alias("pos", "gram"))
    scanned = scanned.withColumn("h", F.xxhash64("gram"))
    votes = scanned.join(known, (scanned.h == known.h) & (scanned.gram == known.known), "left").where("template is not null or gram is null")
    votes = votes.select("id", "th", "n", "label", "template", "phrase", "grams", "needs", "place", "need", "veto", (F.col("pos") - 1).alias("at"))
    diagonals = votes.groupBy("id", "th", "n", "label", "template", "phrase", "grams", "needs", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set(F.when(~F.col("veto"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("need"), F.col("place"))).alias("met"), F.count_if(F.col("veto")).alias("vetoes"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("place").isNull()).alias("times")
    )
    # a template's diagonals in order; a step of more than STEP begins a new span (phrases: any step)
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    spans = diagonals.withColumn("new", F.when(step.isNull() | F.col("phrase") | (step > STEP), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy("id", "th", "n", "label", "template", "phrase", "grams", "needs", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"), F.sum("vetoes").alias("vetoes"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("times").alias("times")
    )
    cover = F.size("places") / F.col("grams")
    own = (F.size("met") >= F.col("needs")) & (F.col("vetoes") == 0)
    good = F.when(F.col("phrase"), cover >= 1).otherwise(own & (cover >= COVER) & (F.col("last") - F.col("first") + K <= STRETCH * (F.col("grams") + K - 1)))
    spans = spans.withColumn("cover", cover).withColumn("good", F.coalesce(good, F.lit(False)))
    base = F.col("good") & F.col("phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("id", "th").agg(
        F.max("n").cast("long").alias("n_words"), F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("good")).alias("labels"), F.coalesce(F.max(F.when(F.col("good"), F.col("cover"))), F.lit(0.0)).alias("score"), F.sum("times").cast("int").alias("times"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
