"""License recognition by sentences: known sentences become identifiers, identifier sequences match ordered rules.
DataFrame functions only, one projection over the documents, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licences after normalisation (lower case, letters and digits only), complete to
#: the mark that ends them; `mit_grant` and `as_is` are their short forms, which texts use as well.
SENTENCES = {
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "apache2_notice": "licensed under the apache license version 2 0",
    "mit_notice": "released under the mit license",
    "ccbync4_notice": "licensed under cc by nc 4 0",
    "mit_title": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_grant_whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind",
    "as_is_whole": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2_title": "apache license",
    "apache2_version": "version 2 0 january 2004",
    "apache2_terms": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "gpl_title": "gnu general public license",
    "gpl_version3": "version 3 29 june 2007",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_free_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl_either3": "either version 3 of the license or at your option any later version",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
#: (licence, identifiers in the order in which they must appear; other sentences may stand between). Earlier rules win
#: over later ones of the same licence.
RULES = (
    ("GPL-3.0", ("gpl_title", "gpl_version3")),
    ("GPL-3.0", ("gpl_free",)),
    ("GPL-3.0", ("gpl_free_only",)),
    ("GPL-3.0", ("gpl_terms", "gpl_either3")),
    ("GPL-3.0", ("gpl3_notice",)),
    ("Apache-2.0", ("apache2_title", "apache2_version")),
    ("Apache-2.0", ("apache2_terms", "apache2_copy")),
    ("Apache-2.0", ("apache2_notice",)),
    ("MIT", ("mit_title", "mit_grant", "mit_condition")),
    ("MIT", ("mit_title", "mit_grant_whole", "mit_condition")),
    ("MIT", ("mit_grant", "mit_condition", "as_is")),
    ("MIT", ("mit_grant", "mit_condition", "as_is_whole")),
    ("MIT", ("mit_grant_whole", "mit_condition", "as_is")),
    ("MIT", ("mit_grant_whole", "mit_condition", "as_is_whole")),
    ("MIT", ("mit_notice",)),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_grant_and",)),
    ("CC-BY-NC-4.0", ("ccbync4_notice",)),
)
#: A licence that holds another one's rule in full hides it.
HIDES = (("BSD-3-Clause", "BSD-2-Clause"),)
#: What becomes a blank line, in this order of use on lower case: the marks that end a sentence, the number of a list item.
ENDS = r"[.!?;]+(?=[ \t\n]|$)|(?<![^\n])[ \t*#/]*\(?(?:[0-9]{1,2}|[a-z])\)[ \t]"
#: What normalisation turns into one blank.
NOISE = r"[^a-z0-9\n]+"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in their order, comma-joined with a comma at both ends.

    A sentence starts at a line's start or after a mark that ends one, ends at a line's end or at such a mark, and may be
    wrapped over any number of lines; a blank line or a mark between its words breaks it. Of sentences that start at the same
    place the longest counts.
    """
    known = F.create_map(*[F.lit(x) for k, v in sentences.items() for x in (v, k)])
    lines = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    lines = F.regexp_replace(F.regexp_replace(lines, ENDS, "\n\n"), NOISE, " ")
    lines = F.regexp_replace(F.trim(lines), " ?\n ?", "\n")
    wrapped = "|".join(v.replace(" ", r"[ \n]") for v in sorted(sentences.values(), key=len, reverse=True))
    found = F.regexp_extract_all(lines, F.lit(rf"(?<![^\n])(?:{wrapped})(?![^\n])"), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))


def follows(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the identifiers of `rule` stand in the comma-joined `ids` in this order, each sought behind the one before."""
    at = F.lit(1)
    for name in rule:
        place = F.call_function("locate", F.lit(f",{name},"), ids, at)
        # Not found stays not found; else on from the comma that ends the name.
        at = F.when((at > 0) & (place > 0), place + len(name) + 1).otherwise(F.lit(0))
    return at > 0


def recognise(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """Add `sentence_ids` (in order, comma-joined), `n_sentences`, `licenses` (sorted, comma-joined).

    Null and empty texts hold no sentence. Every row gives one row. Columns of `docs` with these names are replaced.
    """
    out = docs.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col(text), F.lit("")), sentences))
    hits: dict[str, Column] = {}
    for name, ids in rules:
        met = follows(F.col("sentence_ids"), ids)
        hits[name] = hits[name] | met if name in hits else met
    for winner, loser in HIDES:
        if winner in hits and loser in hits:
            hits[loser] = hits[loser] & ~hits[winner]
    found = F.array(*[F.when(hits[n], F.lit(n)) for n in sorted(hits)])
    return (
        out.withColumn("licenses", F.array_join(found, ","))
        .withColumn("sentence_ids", F.regexp_replace("sentence_ids", "^,+|,+$", ""))
        .withColumn("n_sentences", F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", ","))).cast("long"))
    )
