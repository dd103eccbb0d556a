"""Licence recognition by sentences and ordered rules.

A text is split into sentences, each normalised to lower-case letters and
digits with single spaces. Sentences that the table of known licence sentences
holds become identifiers; the sequence of identifiers is matched against
ordered rules, the longest first. Sentences that are too far apart don't belong
to one rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import keyed

# Names of licences as notices write them, normalised, and their identifiers.
NAMES = {
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "mit license": "MIT",
    "isc license": "ISC",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only",
    "mozilla public license version 2 0": "MPL-2.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc0 1 0": "CC0-1.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
    "apache 2 0 license": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "isc": "ISC",
    "bsd 2 clause": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "gpl v2": "GPL-2.0-only",
    "gpl v3": "GPL-3.0-only",
    "gplv2": "GPL-2.0-only",
    "gplv3": "GPL-3.0-only",
    "gnu general public license v2 0": "GPL-2.0-only",
    "gnu general public license v3 0": "GPL-3.0-only",
    "gnu lesser general public license version 2 1": "LGPL-2.1-only",
    "gnu affero general public license v3 0": "AGPL-3.0-only",
    "mozilla public license 2 0": "MPL-2.0",
    "mpl 2 0": "MPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "boost software license version 1 0": "BSL-1.0",
    "zlib license": "Zlib",
    "unlicense": "Unlicense",
    "artistic license 2 0": "Artistic-2.0",
    "european union public licence 1 2": "EUPL-1.2",
}
# Identifiers that only tags use.
TAGS = ["0BSD", "AGPL-3.0-or-later", "Apache-1.1", "BSD-1-Clause", "BSD-4-Clause", "EPL-1.0", "GPL-2.0", "GPL-2.0+", "GPL-3.0", "GPL-3.0+",
        "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "OFL-1.1", "PSF-2.0", "WTFPL"]
# What may follow the name in a one-line notice, normalised.
TAILS = ["see the license file for details", "see license for details", "see license file for details", "see license for more information", "see the license file for more information"]
# The beginnings of one-line notices that name a licence.
NOTICES = ["licensed under", "released under", "distributed under", "available under",
           "this work is licensed under", "this file is licensed under", "this project is licensed under",
           "this software is licensed under", "this program is licensed under"]

# Sentences of licence texts and headers, normalised.
SENTENCES = {
    "MIT-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "ISC-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "BSD-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Apache-header": "licensed under the apache license version 2 0 the license",
    "Apache-comply": "you may not use this file except in compliance with the license",
    "Apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "GPL-3-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL-2-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "MPL-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
}

# Ordered rules: the sentences that make a licence, in order. A longer rule goes before its beginning.
RULES = [
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty"]),
    ("MIT", ["MIT-grant", "MIT-notice"]),
    ("MIT", ["MIT-grant"]),
    ("ISC", ["ISC-grant"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-names"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("Apache-2.0", ["Apache-header", "Apache-comply", "Apache-as-is"]),
    ("Apache-2.0", ["Apache-header", "Apache-comply"]),
    ("Apache-2.0", ["Apache-header"]),
    ("GPL-3.0-or-later", ["GPL-3-header"]),
    ("GPL-2.0-or-later", ["GPL-2-header"]),
    ("MPL-2.0", ["MPL-header"]),
    ("Unlicense", ["Unlicense"]),
]
GAP = 3  # more unknown sentences than this between two known ones end a sequence

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = r"[.!?;:]+([\x20\x09-\x0D]+|\z)|\n[\x20\x09\x0D]*\n"
TAG = r"spdx-license-identifier:([^\n]*)"  # a sentence of its own, without the colon


def notices() -> dict[str, str]:
    """Normalised one-line notice, without article and tail -> licence."""
    return {f"{n} {name}": licence for n in NOTICES for name, licence in NAMES.items()}


def tags() -> dict[str, str]:
    """Normalised tag -> licence; a later version by ``+`` reads as the identifier without it."""
    names = sorted({*NAMES.values(), *TAGS, *(licence for licence, _ in RULES)}, reverse=True)
    return {f"spdx license identifier {_plain(i)}": i for i in names}


def known() -> dict[str, str]:
    """Normalised sentence -> code of five digits; one-line notices and tags are made from their parts."""
    return {s: f"{i:05d}" for i, s in enumerate(dict.fromkeys([*SENTENCES.values(), *notices(), *tags()]))}


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def rules() -> list[tuple[str, str]]:
    """(codes with a space after each, licence), longer rules first; every one-line notice is a rule of its own."""
    code = known()
    out = [("".join(code[SENTENCES[s]] + " " for s in names), licence) for licence, names in RULES]
    out += [(code[sentence] + " ", licence) for sentence, licence in {**notices(), **tags()}.items()]
    return sorted(dict(out).items(), key=lambda x: (-len(x[0]), x[0]))


def pattern(gap: str) -> str:
    """A regular expression of all known sentences but tags, longer ones first; ``gap`` stands between words.

    Its three groups hold what is kept of one: a sentence, or a notice's beginning and name (no article, no tail).
    """
    def any_of(some):
        return "(?:" + "|".join(x.replace(" ", gap) for x in sorted(some, key=lambda x: (-len(x), x))) + ")"
    return f"(?:({any_of(SENTENCES.values())})|({any_of(NOTICES)})(?:{gap}the)?({gap}{any_of(NAMES)})(?:{gap}{any_of(TAILS)})?)"


def sentences(text):
    """The normalised, non-empty sentences of a text, in order.

    A known sentence that fills whole lines is one of its own, closing mark or not. Marks at line starts (``#``,
    `` *``, ``//``) are no letters, so comments and wrapped sentences are told alike.
    """
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, TAG, "\n\nspdx-license-identifier $1\n\n")
    t = F.regexp_replace(t, ENDS, "\x01")
    t = F.regexp_replace(F.regexp_replace(t, r"[^0-9a-z\x01\n]+", " "), r"\n", "\x02")
    t = F.regexp_replace(t, rf"(?<![^\x01\x02])( ?){pattern('[ \\x02]+')}(?= ?(?:[\x01\x02]|\z))", "\x01$2$3$4\x01")
    t = F.regexp_replace(t, r"[ \x02]+", " ")
    return F.filter(F.transform(F.split(t, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, matches and licences.

    ``matches`` lists each match in order as (licence, codes of its sentences);
    ``licences`` its distinct licences, sorted. Whole texts are read; nothing is
    shuffled, so a row's result depends on that row only.

    A sentence ends at a closing mark or an empty line; a known one may also
    stand on lines of its own, next to lines without a closing mark.

    Null and empty texts have no sentences; repeated rows give a row each; null
    ids stay null; an empty table gives no rows; other columns are not read.
    """
    code, ordered = known(), rules()
    table, names = (F.expr(f"map({', '.join(repr(x) for pair in pairs for x in pair)})") for pairs in (code.items(), ordered))
    listed = ", ".join(map(repr, code))
    rows = keyed(docs, id_col, text_col).select("doc_id", sentences(F.col("text")).alias("s"))
    spots = F.expr(f"filter(transform(s, (s, i) -> struct(i AS i, s AS s)), x -> x.s IN ({listed}))")
    rows = rows.select("doc_id", F.size("s").alias("n_sentences"), spots.alias("spots"))
    step = F.transform("spots", lambda x, k: F.concat(
        F.when((k > 0) & (x["i"] - F.element_at("spots", F.greatest(k, F.lit(1)))["i"] - 1 > gap), F.lit("|")).otherwise(F.lit("")),
        F.element_at(table, x["s"]), F.lit(" ")))
    rows = rows.select("doc_id", "n_sentences", F.size("spots").alias("n_known"), F.array_join(step, "").alias("codes"))
    found = F.regexp_extract_all("codes", F.lit("|".join(r for r, _ in ordered)), F.lit(0))
    rows = rows.withColumn("matches", F.transform(found, lambda c: F.struct(F.element_at(names, c).alias("licence"), F.trim(c).alias("codes"))))
    return rows.select("doc_id", "n_sentences", "n_known", "matches", F.array_sort(F.array_distinct(F.col("matches.licence"))).alias("licences"))
