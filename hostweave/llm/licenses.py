"""Licence recognition by sentences, with DataFrame functions only.

A text is cut into sentences, which are normalised and looked up among known licence sentences.
The identifiers in the order of the text are matched against licence rules, each in turn, the
most specific first; what a rule has matched is used up. Everything happens within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm.tables import only

#: Names of licences as texts give them, normalised.
NAMES = {
    "mit license": "MIT",
    "mit licence": "MIT",
    "isc license": "ISC",
    "unlicense": "Unlicense",
    "boost software license version 1.0": "BSL-1.0",
    "apache license": "Apache",
    "apache license 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "bsd license": "BSD",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "mozilla public license version 2.0": "MPL-2.0",
    "mozilla public license v. 2.0": "MPL-2.0",
    "eclipse public license version 2.0": "EPL-2.0",
    "gnu general public license": "GPL",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "creative commons attribution 4.0 international license": "CC-BY-4.0",
    "creative commons zero": "CC0-1.0",
}
#: Sentences that name a licence.
REFERENCES = (
    "licensed under {}",
    "released under {}",
    "distributed under {}",
    "this work is licensed under {}",
    "this work is released under {}",
    "this file is licensed under {}",
    "this project is licensed under {}",
    "this program is licensed under {}",
    "this software is licensed under {}",
    "this software is released under {}",
    "this source code is licensed under {}",
)
#: Sentences of licence texts and headers, normalised.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
    "above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission": "BSDendorse",
    "you may not use this file except in compliance with the license": "APACHEcomply",
    "you may obtain a copy of the license at": "APACHEcopy",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "APACHEcopy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "APACHEcopy",
    "http www.apache.org licenses license 2.0": "APACHEurl",
    "https www.apache.org licenses license 2.0": "APACHEurl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
    "warranties or conditions of any kind either express or implied": "APACHEasis",
    "licensed under the apache license version 2.0 the license": "APACHEgrant",
    "this program is free software": "GPLfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLterms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version": "GPL3terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 2 of the license or at your option any later version": "GPL2terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version": "GPL3terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 2 of the license or at your option any later version": "GPL2terms",
    "either version 3 of the license or at your option any later version": "GPL3later",
    "either version 2 of the license or at your option any later version": "GPL2later",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLimplied",
    "see the gnu general public license for more details": "GPLsee",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLwarranty",
    "all rights reserved": "RESERVED",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
}
#: Words of which every known sentence holds one; a text without them is not cut up.
HINT = r"(?i)licen[cs]e|free[^a-z0-9.+]+software|permission|redistribution|warranty|liable|reserved|public[^a-z0-9.+]+domain|creative|under[^a-z0-9.+]+(the[^a-z0-9.+]+)?cc"
#: Rules in order: licence and the identifiers it asks for; those with ? may be missing. What no
#: rule uses up and names a licence by itself is that licence.
RULES = (
    ("MIT", "MITgrant MITnotice? MITasis MITliability?"),
    ("ISC", "ISCgrant"),
    ("BSD-3-Clause", "BSDgrant BSDsource BSDbinary BSDendorse"),
    ("BSD-2-Clause", "BSDgrant BSDsource BSDbinary"),
    ("Apache-2.0", "APACHEgrant APACHEcomply? APACHEcopy? APACHEurl? APACHEasis?"),
    ("Apache-2.0", "ref:Apache-2.0 APACHEcomply APACHEcopy? APACHEurl? APACHEasis?"),
    ("GPL-3.0-or-later", "GPLfree? GPL3terms GPLwarranty? GPLimplied? GPLsee?"),
    ("GPL-3.0-or-later", "GPLfree? GPLterms GPL3later GPLwarranty? GPLimplied? GPLsee?"),
    ("GPL-2.0-or-later", "GPLfree? GPL2terms GPLwarranty? GPLimplied? GPLsee?"),
    ("GPL-2.0-or-later", "GPLfree? GPLterms GPL2later GPLwarranty? GPLimplied? GPLsee?"),
    ("Unlicense", "UNLICENSE"),
    ("proprietary", "RESERVED"),
)
#: Abbreviations in holders' names.
ABBREVIATED = "Corp|Inc|Ltd|Co|LLC|Bros|Jr|Sr|Dr|St"
#: Cuts sentences apart; no text of ours holds it.
CUT = "\x1e"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = r"[\x20\x09-\x0D]"


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: licence texts, and every way to refer to every licence."""
    names = {f"the {n}": i for n, i in NAMES.items()} | NAMES
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            names[f"cc {kind} {version}"] = f"CC-{kind.upper().replace(' ', '-')}-{version}"
    return SENTENCES | {form.format(name): f"ref:{i}" for name, i in names.items() for form in REFERENCES}


def rule_pattern(rule: str) -> str:
    """What the rule matches in identifiers written as <a><b>."""
    parts = [(part.rstrip("?").replace(".", r"\."), part.endswith("?")) for part in rule.split()]
    return "".join(f"(<{name}>)?" if optional else f"<{name}>" for name, optional in parts)


def openings() -> str:
    """What known sentences begin with, in any case and over line ends: their first five words, or a reference's words before the name."""
    first = {form.split(" {}")[0] for form in REFERENCES} | {" ".join(x.split()[:5]) for x in SENTENCES}
    return "|".join(x.replace(".", r"\.").replace(" ", rf"[^A-Za-z0-9.+]+") for x in sorted(first, key=lambda x: (-len(x), x)))


def cuts() -> list[tuple[str, str]]:
    """Patterns and what replaces them, in order, in a dialect that Java and RE2 share.

    A sentence ends with .;:!? before white space, unless the full stop is an abbreviation's, and with an empty line. Lines of a
    paragraph are one text, but a sentence begins with a line that opens like a known one; and a reference that ends its
    line before a line with a capital and a small letter ends there, if no version follows.
    """
    return [
        (rf"\n{WHITE}*\n", CUT),
        (rf"([;:]){WHITE}+", f"$1{CUT}"),
        (rf"\b({ABBREVIATED})\.{WHITE}+", "$1., "),
        (rf"([.!?]){WHITE}+", f"$1{CUT}"),
        (rf"(?i)\n({WHITE}*({openings()})[^A-Za-z0-9])", f"{CUT}$1"),
        (rf"\n({WHITE}*[Vv]ersion)", " $1"),
        (rf"((?:[Ll]icensed|[Rr]eleased|[Dd]istributed) under [^\n,]+)\n({WHITE}*\p{{Lu}}\p{{Ll}})", f"$1{CUT}$2"),
    ]


#: Any holder's name stands for the copyright holder in a sentence that names one; normalised.
HOLDER = (r"^neither the name of .{1,200} nor the names of its contributors may", "neither the name of the copyright holder nor the names of its contributors may")


def sentences(text: Column) -> Column:
    """Normalised sentences, cut by ``cuts``: a-z, 0-9, + and . stay, all else is one space."""
    cut = text
    for pattern, put in cuts():
        cut = F.regexp_replace(cut, pattern, put)
    small = F.translate(cut, CAPITALS, CAPITALS.lower())

    def plain(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.+]+", " "), r"[. ]+$", "")
        return F.regexp_replace(F.trim(s), *HOLDER)

    return F.transform(F.split(small, CUT), plain)


def license_scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences (known ones), sentence_ids in order, licences (by the rules in
    their order, then those named alone in order of the text) and n_unmatched (sentences of no match).

    Null and empty texts, and texts without a known sentence, have 0 and empty strings. Every row
    is scanned on its own, repeated and null doc_ids too; texts of any length are scanned whole.
    Other columns are not read. An empty table gives no row.
    """
    known = known_sentences()
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.filter(sentences(F.col("text")), lambda s: s.isin(list(known)))
    found = F.when(F.col("text").rlike(HINT), F.transform(found, lambda s: F.element_at(ids, s))).otherwise(F.array().cast("array<string>"))
    rows = only(documents, "doc_id", "text").select("doc_id", found.alias("_ids"))
    rows = rows.withColumn("_left", F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    matched = []
    for k, (name, rule) in enumerate(RULES):
        pattern = rule_pattern(rule)
        rows = rows.withColumn(f"_n{k}", F.regexp_count("_left", F.lit(pattern))).withColumn("_left", F.regexp_replace("_left", pattern, "|"))
        matched.append(F.array_repeat(F.lit(name), F.col(f"_n{k}")))
    named = F.regexp_extract_all("_left", F.lit("<ref:([^>]+)>"), F.lit(1))
    return rows.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", " ").alias("sentence_ids"),
        F.array_join(F.concat(F.flatten(F.array(*matched)), named), " ").alias("licences"),
        (F.regexp_count("_left", F.lit("<")) - F.size(named)).cast("long").alias("n_unmatched"),
    )


def sql() -> str:
    """The scan in DuckDB's SQL."""
    known = ", ".join(f"'{s}': '{i}'" for s, i in known_sentences().items())
    steps, names, last = [], [], "m"
    for k, (name, rule) in enumerate(RULES):
        pattern = rule_pattern(rule)
        steps.append(
            f"r{k} AS (SELECT *, len(regexp_extract_all(l{k}, '{pattern}')) AS n{k}, regexp_replace(l{k}, '{pattern}', '|', 'g') AS l{k + 1} FROM {last})"
        )
        names.append(f"repeat('{name} ', n{k}::INT)")
        last = f"r{k}"
    end = f"l{len(RULES)}"
    cut = "text"
    for pattern, put in cuts():
        put = "' || chr(30) || '".join(put.replace("$", "\\").split(CUT))
        cut = f"regexp_replace({cut}, '{pattern}', '{put}', 'g')"
    return rf"""
WITH k AS (SELECT MAP {{{known}}} AS ids),
c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{HINT}') THEN {cut} END AS t FROM documents),
s AS (SELECT doc_id, list_transform(string_split(translate(coalesce(t, ''), '{CAPITALS}', '{CAPITALS.lower()}'), chr(30)),
        lambda x: regexp_replace(trim(regexp_replace(regexp_replace(x, '[^a-z0-9.+]+', ' ', 'g'), '[. ]+$', '')), '{HOLDER[0]}', '{HOLDER[1]}')) AS s FROM c),
i AS (SELECT doc_id, list_filter(list_transform(s, lambda x: ids[x]), lambda x: x IS NOT NULL) AS i FROM s, k),
m AS (SELECT doc_id, i, coalesce(array_to_string(list_transform(i, lambda x: '<' || x || '>'), ''), '') AS l0 FROM i),
{", ".join(steps)},
f AS (SELECT *, regexp_extract_all({end}, '<ref:([^>]+)>', 1) AS named FROM {last})
SELECT doc_id, CAST(len(i) AS BIGINT) AS n_sentences, coalesce(array_to_string(i, ' '), '') AS sentence_ids,
       trim(concat({", ".join(names)}, coalesce(array_to_string(named, ' '), ''))) AS licences,
       CAST(len(regexp_extract_all({end}, '<')) - len(named) AS BIGINT) AS n_unmatched
FROM f
"""
