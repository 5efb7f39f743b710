"""License scans by sentence rules, in column expressions alone.

A text is cut into sentences, each sentence normalised to lower-case words, known licence sentences replaced by
identifiers, and the row of identifiers compared with ordered rules: a rule matches where its identifiers
stand next to each other, sentences that are no licence sentences aside. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Sentences of public licence texts and notices, normalised to lower-case words.
SENTENCES = {
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_terms": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_url": "http www apache org licenses license 2 0",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "apache_title": "apache license",
    "apache_date": "version 2 0 january 2004",
    "mit_notice": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd_use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd_liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl_title": "gnu general public license",
    "lgpl_title": "gnu lesser general public license",
    "agpl_title": "gnu affero general public license",
    "gpl2_date": "version 2 june 1991",
    "lgpl21_date": "version 2 1 february 1999",
    "gpl3_date": "version 3 29 june 2007",
    "agpl3_date": "version 3 19 november 2007",
    "gnu_verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "lgpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_details": "see the gnu lesser general public license for more details",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_details": "see the gnu affero general public license for more details",
    "cc_by_nc_notice": "licensed under cc by nc 4 0",
    "cc_by_notice": "licensed under cc by 4 0",
    "cc_by_sa_notice": "licensed under cc by sa 4 0",
    "cc0_notice": "this work is dedicated to the public domain under cc0 1 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "epl_terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "boost_notice": "distributed under the boost software license version 1 0",
    "boost_title": "boost software license version 1 0 august 17th 2003",
    "zlib_warranty": "this software is provided as is without any express or implied warranty",
    "zlib_liability": "in no event will the authors be held liable for any damages arising from the use of this software",
}
# Licence, kind of evidence, and the sentences in their order.
RULES = (
    ("Apache-2.0", "notice", ("apache_notice",)),
    ("Apache-2.0", "header", ("apache_notice", "apache_comply", "apache_copy", "apache_url", "apache_as_is", "apache_see")),
    ("Apache-2.0", "header", ("apache_terms", "apache_copy", "apache_url", "apache_as_is", "apache_see")),
    ("Apache-2.0", "text", ("apache_title", "apache_date")),
    ("MIT", "notice", ("mit_notice",)),
    ("MIT", "notice", ("mit_licensed",)),
    ("MIT", "text", ("mit_grant", "mit_keep", "mit_warranty", "mit_liability")),
    ("BSD-2-Clause", "text", ("bsd_use", "bsd_source", "bsd_binary", "bsd_warranty", "bsd_liability")),
    ("BSD-3-Clause", "text", ("bsd_use", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty", "bsd_liability")),
    ("GPL-3.0", "notice", ("gpl3_notice",)),
    ("GPL-3.0", "header", ("gpl3_free", "gpl_hope", "gpl_details")),
    ("GPL-2.0", "header", ("gpl2_free", "gpl_hope", "gpl_details")),
    ("LGPL-3.0", "header", ("lgpl3_free", "gpl_hope", "lgpl_details")),
    ("LGPL-2.1", "header", ("lgpl21_free", "lgpl_hope", "lgpl_details")),
    ("AGPL-3.0", "header", ("agpl3_free", "gpl_hope", "agpl_details")),
    ("GPL-2.0", "text", ("gpl_title", "gpl2_date", "gnu_verbatim")),
    ("GPL-3.0", "text", ("gpl_title", "gpl3_date", "gnu_verbatim")),
    ("LGPL-2.1", "text", ("lgpl_title", "lgpl21_date", "gnu_verbatim")),
    ("LGPL-3.0", "text", ("lgpl_title", "gpl3_date", "gnu_verbatim")),
    ("AGPL-3.0", "text", ("agpl_title", "agpl3_date", "gnu_verbatim")),
    ("CC-BY-NC-4.0", "notice", ("cc_by_nc_notice",)),
    ("CC-BY-4.0", "notice", ("cc_by_notice",)),
    ("CC-BY-SA-4.0", "notice", ("cc_by_sa_notice",)),
    ("CC0-1.0", "notice", ("cc0_notice",)),
    ("ISC", "text", ("isc_grant",)),
    ("MPL-2.0", "notice", ("mpl_subject",)),
    ("Unlicense", "text", ("unlicense_free",)),
    ("EPL-2.0", "notice", ("epl_terms",)),
    ("BSL-1.0", "notice", ("boost_notice",)),
    ("BSL-1.0", "text", ("boost_title",)),
    ("Zlib", "text", ("zlib_warranty", "zlib_liability")),
)
# Every rule has a sentence with one of these words: texts without them are not cut.
ANCHORS = ("license", "software", "warranty", "cc0")
BREAK = "\u0001"
# in this order: a comment that follows other lines; comment marks at line starts and ends; points of abbreviations; links; ends of sentences; colons ahead of a
# capital; line breaks that do not go on in lower case
CUTS = (
    (r"(^|\n)([^#/*; \t\r\n-][^\n]*)\n([ \t]*(/\*+|#|//))", "$1$2\n\n$3"),
    (r"\n[ \t]*(/\*+|#|//|\*|;|--)+[ \t]*", "\n"),
    (r"\b([vV]|[nN]o)\.[ \t\r\n]+", "$1 "),
    (r"https?(://[^ \t\r\n]+)", BREAK + "http$1" + BREAK),
    (r"([.!?])[ \t\r\n]+", "$1" + BREAK),
    (r":[ \t\r\n]+([A-Z0-9])", BREAK + "$1"),
    (r"\n[ \t\r]*([^a-z \t\r])", BREAK + "$1"),
)
WRAPPED = (*CUTS[:6], (r"\n[ \t\r]*\n", BREAK))


def identifiers(text: str = "text"):
    """The identifiers of the known sentences of a text, in order, as (place, id), places counted over all sentences.

    Sentences end at full stops. A line break ends one too, unless the next line goes on in lower case; as
    wrapped lines may also go on in capitals, a second reading ends sentences at full stops and blank lines only.
    The reading with more known sentences counts, the first if they tie.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = F.create_map(*[F.lit(v) for name, sentence in SENTENCES.items() for v in (sentence, name)])

    def read(cuts):
        marked = whole
        for pattern, by in cuts:
            marked = F.regexp_replace(marked, pattern, by)
        plain = F.regexp_replace(F.lower(marked), "[^a-z0-9" + BREAK + "]+", " ")
        parts = F.transform(F.split(plain, BREAK), lambda s, i: F.struct(i.alias("place"), F.try_element_at(known, F.trim(s)).alias("id")))
        return F.filter(parts, lambda p: p["id"].isNotNull())

    anchored = F.lower(whole).rlike("|".join(ANCHORS))
    return F.when(anchored, F.array(read(CUTS), read(WRAPPED)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, kind, sentences (of the rule) and place (of the first sentence) of every rule that a text matches.

    A rule counts once per text, at its first match. A null or empty text matches nothing; rows that share a
    doc_id each give their matches, a null doc_id is kept. Columns besides doc_id and text are not read.
    """
    both = docs.select("doc_id", identifiers().alias("both")).where("size(both[0]) > 0 or size(both[1]) > 0")
    found = both.select("doc_id", F.expr("if(size(both[1]) > size(both[0]), both[1], both[0])").alias("found"))
    named = found.withColumn("row", F.concat(F.lit(","), F.array_join(F.transform("found", lambda p: p["id"]), ","), F.lit(",")))
    rules = F.array(*[F.struct(F.lit(l).alias("licence"), F.lit(k).alias("kind"), F.lit(len(s)).alias("sentences"), F.lit("," + ",".join(s) + ",").alias("needle")) for l, k, s in RULES])
    matches = named.select("doc_id", "found", "row", F.explode(F.filter(rules, lambda r: F.instr(F.col("row"), r["needle"]) > 0)).alias("r"))
    # the commas before the match tell how many identifiers stand before it
    ahead = F.expr("substring(row, 1, instr(row, r.needle) - 1)")
    nth = F.length(ahead) - F.length(F.replace(ahead, F.lit(","), F.lit("")))
    return matches.select("doc_id", "r.licence", "r.kind", "r.sentences", F.get("found", nth)["place"].alias("place"))


def scan_sql() -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def parts(cuts):
        text = "coalesce(text, '')"
        for pattern, by in cuts:
            by = by.replace("$", "\\")
            shown = "'" + by.replace("\n", "' || chr(10) || '").replace(BREAK, "' || chr(1) || '") + "'"
            text = f"regexp_replace({text}, {quoted(pattern)}, {shown}, 'g')"
        return f"string_split(regexp_replace(lower({text}), '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1))"

    sentences = ", ".join(f"({quoted(s)}, {quoted(n)})" for n, s in SENTENCES.items())
    rules = ", ".join(f"({quoted(l)}, {quoted(k)}, {len(s)}, {quoted(',' + ','.join(s) + ',')})" for l, k, s in RULES)
    return f"""
    WITH known(sentence, id) AS (VALUES {sentences}), rules(licence, kind, sentences, needle) AS (VALUES {rules}),
    docs AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
    cut AS (SELECT doc_id, rid, 1 AS reading, {parts(CUTS)} AS parts FROM docs UNION ALL
            SELECT doc_id, rid, 2, {parts(WRAPPED)} FROM docs),
    told AS (SELECT doc_id, rid, reading, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS place FROM cut),
    read_ AS (SELECT doc_id, rid, reading, list(id ORDER BY place) AS ids, list(place ORDER BY place) AS places
              FROM told JOIN known ON trim(s) = sentence GROUP BY doc_id, rid, reading),
    named AS (SELECT * FROM read_ QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len(ids) DESC, reading) = 1),
    rowed AS (SELECT *, ',' || array_to_string(ids, ',') || ',' AS row_ FROM named),
    hits AS (SELECT doc_id, places, licence, kind, sentences, substr(row_, 1, instr(row_, needle) - 1) AS ahead
             FROM rowed, rules WHERE instr(row_, needle) > 0)
    SELECT doc_id, licence, kind, CAST(sentences AS INTEGER) AS sentences,
           CAST(places[length(ahead) - length(replace(ahead, ',', '')) + 1] AS INTEGER) AS place FROM hits
    """
