"""Licence scans with a positional index of rare licence words.

A licence text stands at a place of a file if enough of its words stand there at their
distances (SHARE of the text, VOTES at least) and its mandatory phrases stand in that
stretch or within NEAR words of it. Candidates come from the index alone: of each text it
holds the words of highest IDF (over all files), with their places, until they cover so
many places that wherever a text stands, VOTES of them must agree on its begin. Rarer
words are thus looked up first, whatever their share of the files, and nothing is lost by
leaving out the common ones. The index is as large as the texts below, whatever the corpus.

Openings and notices are looked for, as they name a licence; a file with the opening alone
has its label. Words inserted into a text shift what follows, so the longer part must make
up the share.

Column expressions only; one pass counts the files that hold each licence word, a
second scans. Null and empty texts have no words and no labels. Rows don't meet beyond
these counts, and these don't change results, so repeated rows give repeated results;
other columns are not looked at. Time and memory are linear in a text's words.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.binding import bind
from driftpanel.llm.common import only, prepared

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Openings of well-known licence texts, with phrases that must be there.
TEXTS = (
    ("mit-text",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
     "merge publish distribute sublicense and or sell copies of the software",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("isc-text",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies",
     ("with or without fee is hereby granted",)),
    ("bsd-text",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer",
     ("redistribution and use in source and binary forms",)),
    ("apache-2-notice",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at",
     ("licensed under the apache license version 2 0",)),
    ("mit-notice", "released under the mit license", ("under the mit license",)),
    ("gpl-notice",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version",
     ("under the terms of the gnu general public license",)),
    ("lgpl-notice",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
     "license as published by the free software foundation",
     ("gnu lesser general public license",)),
    ("mpl-2-notice",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
     "with this file you can obtain one at",
     ("subject to the terms of the mozilla public license",)),
    ("cc-by-notice",
     "this work is licensed under a creative commons attribution 4 0 international license",
     ("licensed under a creative commons attribution",)),
    ("cc-by-nc-notice",
     "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial",)),
    ("unlicense",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
     "or distribute this software",
     ("free and unencumbered software released into the public domain",)),
    ("agpl-notice",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
     "license as published by the free software foundation either version",
     ("gnu affero general public license",)),
    ("boost-text",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
     ("any person or organization obtaining a copy of the software",)),
    ("zlib-text",
     "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
     "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
     ("will the authors be held liable for any damages", "to alter it and redistribute it freely")),
    ("epl-2-notice",
     "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
     "available at",
     ("under the terms of the eclipse public license",)),
    ("cc-by-sa-notice",
     "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike",)),
    ("cc0-notice",
     "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     ("waived all copyright and related or neighboring rights",)),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOTES = 2  # indexed words that must agree on a begin
SHARE = 0.4  # of a text's words that must stand at their places
NEAR = 20  # words before and after a text among which its phrases may stand
VOCABULARY = sorted({w for _, text, _ in TEXTS for w in text.split()})


def needed(text: str) -> int:
    """How many of a licence text's words must stand at their places."""
    return max(VOTES, math.ceil(SHARE * len(text.split())))


def words_of(text: Column) -> Column:
    given = F.coalesce(text, F.lit(""))
    # Beyond ASCII, lower() knows more than A to Z.
    low = F.when(F.length(given) == F.octet_length(given), F.lower(given)).otherwise(
        F.translate(given, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def stand_at(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == part)
        return found

    return F.when((F.size(words) >= len(parts)) & F.array_contains(words, max(parts, key=len)), F.filter(starts, here)).otherwise(
        F.array().cast("array<int>"))


def files_of(words: DataFrame) -> dict[str, int]:
    """How many files hold each licence word."""
    listed = F.array(*[F.lit(w) for w in VOCABULARY])
    held = words.select(F.explode(F.array_intersect("words", listed)).alias("word"))
    found = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: found.get(w, 0) for w in VOCABULARY}


def index_of(files: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> (text, place) of the rarest words of each text, as many as the text needs."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(TEXTS):
        words = text.split()
        # At most `spare` places may go unmatched besides VOTES matching ones.
        covered, spare = 0, len(words) - needed(text)
        for word in sorted(set(words), key=lambda w: (files[w], w)):
            if covered >= spare + VOTES:
                break
            places = [p for p, w in enumerate(words) if w == word]
            index.setdefault(word, []).extend((t, p) for p in places)
            covered += len(places)
    return index


def texts_at(words: Column, held: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """(label, share) of the licence texts that stand in the words; `held` are the licence words among them."""
    texts = F.array(*[F.struct(
        F.lit(t).alias("text"), F.lit(label).alias("label"), F.lit(text.split()).alias("words"), F.lit(needed(text)).alias("need"),
        F.lit(sorted(set(" ".join(must).split()))).alias("first"), F.lit([f" {p} " for p in must]).alias("must"))
        for t, (label, text, must) in enumerate(TEXTS)])
    postings = F.create_map(*[x for w, places in sorted(index.items()) for x in (F.lit(w), F.array(*[
        F.struct(F.lit(t).alias("text"), F.lit(p).alias("place")) for t, p in places]))])
    rare = sorted(index)

    # Only texts all of whose phrases' words the file holds.
    possible = F.transform(F.filter(texts, lambda t: F.size(F.array_except(t["first"], held)) == 0), lambda t: t["text"])

    def votes(possible: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(rare))
        return F.array_sort(F.flatten(F.transform(at, lambda x: F.transform(
            F.filter(F.element_at(postings, x["word"]), lambda p: F.array_contains(possible, p["text"])),
            lambda p: F.struct(p["text"].alias("text"), (x["at"] - p["place"]).alias("begin"))))))

    # Each place of a text votes once for a begin: of sorted votes, those that start a run long enough.
    def begins(v: Column) -> Column:
        return F.filter(v, lambda x, i: (F.get(v, i + (VOTES - 1)) == x) & ((i == 0) | (F.get(v, i - 1) != x)))

    def checked(c: Column) -> Column:
        text, begin = F.get(texts, c["text"]), c["begin"]
        size = F.size(text["words"])
        matched = F.size(F.filter(F.transform(text["words"], lambda w, k: F.get(words, begin + k) == w), lambda same: same))
        start = F.greatest(begin - NEAR, F.lit(0))
        stretch = F.concat(F.lit(" "), F.array_join(F.slice(words, start + 1, begin + size + NEAR - start), " "), F.lit(" "))
        # The phrases are read only where enough words stand at their places.
        stands = F.when(matched >= text["need"], bind(stretch, lambda s: F.forall(text["must"], lambda p: F.contains(s, p)))).otherwise(False)
        return F.struct(stands.alias("stands"), text["label"].alias("label"), (matched / size).alias("share"))

    none = F.array().cast("array<struct<stands:boolean,label:string,share:double>>")
    found = bind(possible, lambda ts: F.when(F.size(ts) > 0, bind(votes(ts), lambda v: F.transform(begins(v), checked))).otherwise(none))
    return F.filter(found, lambda c: c["stands"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_words, places (of the phrases), base_labels, text_labels, score."""
    prepared(docs.sparkSession)
    named = only(docs, doc_id=doc_id, text=text).select("doc_id", words_of(F.col("text")).alias("words"))
    index = index_of(files_of(named))
    places = [stand_at(F.col("words"), phrase) for phrase, _ in PHRASES]
    held = F.array_intersect("words", F.array(*[F.lit(w) for w in VOCABULARY]))
    seen = named.select("doc_id", "words", F.array(*places).alias("by_phrase"))
    # Bound, as a column of its own would be written out inside the lambdas and computed per text.
    seen = seen.withColumn("found", bind(held, lambda held: texts_at(F.col("words"), held, index)))
    base_labels = F.filter(F.array(*[F.when(F.size(F.get("by_phrase", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]),
                           lambda x: x.isNotNull())
    every = F.flatten("by_phrase")
    share = F.array_max(F.transform("found", lambda c: c["share"]))
    return seen.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_sort(every).alias("places"),
                       F.array_sort(F.array_distinct(base_labels)).alias("base_labels"),
                       F.array_sort(F.array_distinct(F.transform("found", lambda c: c["label"]))).alias("text_labels"),
                       F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"))


def digest(found: DataFrame) -> DataFrame:
    labels = F.array_sort(F.array_union("base_labels", "text_labels"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")
