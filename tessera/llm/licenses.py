"""Licence scan: normalised sentences become known sentence identifiers, whose sequence is matched against ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only

#: Known licence sentences, normalised (lower case, everything but a-z and 0-9 a single blank); fixed values.
SENTENCES = {
    "A": "all rights reserved",
    "B": "released under the mit license",
    "C": "licensed under the mit license",
    "D": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "E": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "F": "licensed under the apache license version 2 0",
    "G": "licensed under the apache license version 2 0 the license",
    "H": "you may not use this file except in compliance with the license",
    "I": "you may obtain a copy of the license at",
    "J": "this work is licensed under the gnu general public license version 3",
    "K": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "L": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "M": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "N": "see the gnu general public license for more details",
    "O": "licensed under cc by nc 4 0",
    "P": "licensed under cc by 4 0",
    "Q": "licensed under cc by sa 4 0",
    "R": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "S": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "T": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "U": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "V": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "W": "this is free and unencumbered software released into the public domain",
    "LGPL21": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPL3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LESSER": "see the gnu lesser general public license for more details",
    "LIBRARY": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "AGPL3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AFFERO": "see the gnu affero general public license for more details",
    "EPL2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "BOOST": "distributed under the boost software license version 1 0",
    "CC0": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "ASIS": "this software is provided as is without any express or implied warranty",
    "NOEVENT": "in no event will the authors be held liable for any damages arising from the use of this software",
    "ANYONE": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "PERL": "this library is free software you can redistribute it and or modify it under the same terms as perl itself",
    "X": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}

#: Rules in order: the licence and the sentences that state it one after the other. An earlier rule takes its sentences
#: before a later one looks, so whole texts stand before notices and longer notices before their beginnings; fixed values.
RULES = [
    ("MIT", "D E"),
    ("BSD-3-Clause", "R S T U"),
    ("BSD-2-Clause", "R S T"),
    ("Zlib", "ASIS NOEVENT ANYONE"),
    ("Apache-2.0", "G H I"),
    ("GPL-3.0-or-later", "K M N"),
    ("GPL-2.0-or-later", "L M N"),
    ("AGPL-3.0-or-later", "AGPL3 M AFFERO"),
    ("LGPL-2.1-or-later", "LGPL21 LIBRARY LESSER"),
    ("LGPL-3.0-or-later", "LGPL3 LIBRARY LESSER"),
    ("GPL-3.0-or-later", "K"),
    ("GPL-2.0-or-later", "L"),
    ("AGPL-3.0-or-later", "AGPL3"),
    ("LGPL-2.1-or-later", "LGPL21"),
    ("LGPL-3.0-or-later", "LGPL3"),
    ("MIT", "B"),
    ("MIT", "C"),
    ("Apache-2.0", "G"),
    ("Apache-2.0", "F"),
    ("GPL-3.0", "J"),
    ("CC-BY-NC-4.0", "O"),
    ("CC-BY-SA-4.0", "Q"),
    ("CC-BY-4.0", "P"),
    ("CC0-1.0", "CC0"),
    ("MPL-2.0", "V"),
    ("EPL-2.0", "EPL2"),
    ("BSL-1.0", "BOOST"),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", "PERL"),
    ("Unlicense", "W"),
    ("ISC", "X"),
    ("all-rights-reserved", "A"),
]


def marked(codes: str) -> str:
    """A sequence of identifiers as it stands among others, so that none is found inside another."""
    return "".join(f"<{c}>" for c in codes.split())


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space, and at line ends; scan() also joins lines."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, rule_no, license_id, n_matches, first_sentence): a row for every rule that a document's text states.

    Sentences that are known one by one become identifiers; others are passed over. Neighbouring lines that a known sentence is
    wrapped over count as that sentence, and what is known within them does not; comment marks before them are no letters and
    so fall away, but a blank line or the end of a sentence is not crossed. A rule matches where its identifiers
    follow each other in what is left, as often as it can without overlap, and takes them from the rules after it.
    first_sentence counts all sentences of the text, each line as one, from 0. Only built-in functions; the known sentences (a fixed table of
    this module or the caller's) are broadcast.

    Null, empty and unlicensed texts give no rows; repeated rows (equal in id and text) give their rows once; a null id stays
    null; an empty table gives no rows; other columns are not looked at.
    """
    known, rules = known or SENTENCES, rules or RULES
    for code, sentence in known.items():
        if sentence != " ".join(re.findall("[a-z0-9]+", sentence)) or not sentence or not re.fullmatch(r"[^\s<>]+", code):
            raise ValueError(f"the known sentence {code!r} isn't in its normal form")
    if missing := {c for _, codes in rules for c in codes.split()} - set(known):
        raise ValueError(f"rules name unknown sentences: {', '.join(sorted(missing))}")
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(v, k) for k, v in known.items()], "sentence string, code string"))
    split = [v.split() for v in known.values()]
    begins = {" ".join(w[:k]) for w in split for k in range(1, len(w) + 1)}
    most = max(map(len, split))
    parts = only(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    # a full stop stays behind lines that end a sentence: lines joined over it are not known
    lines = F.transform(sentences(F.col("text")), lambda x: F.concat(normalised(x), F.when(F.rlike(x, F.lit(r"[.!?]\s*$")), ".").otherwise("")))
    parts = parts.select("doc_id", F.xxhash64("doc_id", "text").alias("r"), lines.alias("lines"))
    parts = parts.select("doc_id", "r", "lines", F.posexplode("lines").alias("at", "first")).where(F.rtrim("first", F.lit(".")).isin(sorted(begins)))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.size("lines") - F.col("at"), F.lit(most))), lambda k: F.struct(k.alias("many"), F.rtrim(F.array_join(F.slice("lines", F.col("at") + 1, k), " "), F.lit(".")).alias("sentence")))
    runs = parts.select("doc_id", "r", "at", F.explode(runs).alias("x")).select("doc_id", "r", "at", "x.*")
    seen = runs.join(table, "sentence").groupBy("doc_id", "r").agg(F.sort_array(F.collect_set(F.struct("at", "many", "code"))).alias("s"))
    seen = seen.withColumn("long", F.filter("s", lambda x: x["many"] > 1))
    within = lambda x: F.exists("long", lambda y: (y["many"] > x["many"]) & (y["at"] <= x["at"]) & (y["at"] + y["many"] >= x["at"] + x["many"]))
    seen = seen.withColumn("s", F.filter("s", lambda x: ~within(x)))
    state = seen.select("doc_id", F.col("s.at").alias("at"), F.array_join(F.transform("s.code", lambda c: F.concat(F.lit("<"), c, F.lit(">"))), "").alias("left0"))
    found = []
    for k, (name, codes) in enumerate(rules):
        left, sequence = F.col(f"left{k}"), marked(codes)
        count = (F.length(left) - F.length(F.replace(left, F.lit(sequence), F.lit("")))) / len(sequence)
        place = F.size(F.split(F.substring_index(left, sequence, 1), "<")) - 1  # identifiers before the first match
        found.append(F.struct(F.lit(k).alias("rule_no"), F.lit(name).alias("license_id"), count.cast("int").alias("n_matches"), F.get("at", place).cast("long").alias("first_sentence")))
        state = state.withColumn(f"left{k + 1}", F.replace(left, F.lit(sequence), F.lit("<_>" * len(codes.split()))))
    return state.select("doc_id", F.explode(F.array(*found)).alias("m")).select("doc_id", "m.*").where("n_matches > 0")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    rows = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    lefts, outs = ["s0 AS (SELECT doc_id, ats, codes AS l FROM seqs)"], []
    for k, (name, codes) in enumerate(RULES):
        m = marked(codes)
        outs.append(f"SELECT doc_id, {k} AS rule_no, '{name}' AS license_id, CAST((length(l) - length(replace(l, '{m}', ''))) // {len(m)} AS INTEGER) AS n_matches, CAST(ats[len(string_split(string_split(l, '{m}')[1], '<'))] AS BIGINT) AS first_sentence FROM s{k} WHERE contains(l, '{m}')")
        lefts.append(f"s{k + 1} AS (SELECT doc_id, ats, replace(l, '{m}', '{'<_>' * len(codes.split())}') AS l FROM s{k})")
    return f"""
WITH known(sentence, code) AS (VALUES {rows}),
lists AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(s) AS raw, unnest(range(len(s))) AS pos FROM lists),
hits AS (SELECT p.doc_id, p.pos, k.code FROM (SELECT doc_id, pos, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM parts) p JOIN known k ON p.sentence = k.sentence),
seqs AS (SELECT doc_id, list(pos ORDER BY pos) AS ats, string_agg('<' || code || '>', '' ORDER BY pos) AS codes FROM hits GROUP BY doc_id),
{", ".join(lefts)}
{" UNION ALL ".join(outs)}"""


__all__ = ["RULES", "SENTENCES", "normalised", "oracle", "scan", "sentences"]
