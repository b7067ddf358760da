"""Licence recognition by sentences and rules, in DataFrame operations only.

A text is cut into units at blank lines, list items and sentence ends; comment leaders and list numbers go, and lines that
are only wrapped stay together.  A unit is normalised (lower case, marks to single spaces, line ends kept) and mapped to the
identifier of the known licence sentence that it is, or that its last lines are; lines before that, and the lines of other
units, are mapped one by one.  The identifiers of a document, in order, with a break for each run of other sentences, are
then matched against ordered rules; a rule takes the identifiers that it matches, so longer rules stand first.

Only documents and units with a cue word are looked at closely; every known sentence has one, whatever its spacing (a test
holds them to it).  There is no shuffle.

Defined results: a null or empty text has no licences; repeated rows give repeated rows; sentences that recur count each
time; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cue words, names of licences, sentences (an identifier and what the whole sentence is), and rules (a
# licence and a sequence of identifiers).
CUE = r"licen[sc]e|copyright|reserved|redistribut|warrant|permission|public\W+domain|spdx|\bcc\W*by\b|\bcc0|creative\W+commons|as\W+is\b"
L = "licen[sc]e"
V = "(?: version)? v?"
NAMES = (
    ("Apache-2.0", rf"apache(?: software)? {L}{V}2(?:\.0)?"),
    ("Apache-1.1", rf"apache(?: software)? {L}{V}1\.1"),
    ("MIT", rf"(?:mit|expat|x11)(?: mit| x11)? {L}"),
    ("AGPL-3.0", rf"(?:gnu affero general public {L}|gnu agpl|agpl){V}3(?:\.0)?"),
    ("LGPL-2.0", rf"(?:gnu (?:lesser|library) general public {L}|gnu lgpl|lgpl){V}2(?:\.0)?"),
    ("LGPL-2.1", rf"(?:gnu (?:lesser|library) general public {L}|gnu lgpl|lgpl){V}2\.1"),
    ("LGPL-3.0", rf"(?:gnu lesser general public {L}|gnu lgpl|lgpl){V}3(?:\.0)?"),
    ("GPL-1.0", rf"(?:gnu general public {L}|gnu gpl|gpl){V}1(?:\.0)?"),
    ("GPL-2.0", rf"(?:gnu general public {L}|gnu gpl|gpl){V}2(?:\.0)?"),
    ("GPL-3.0", rf"(?:gnu general public {L}|gnu gpl|gpl){V}3(?:\.0)?"),
    ("GFDL-1.2", rf"gnu free documentation {L}{V}1\.2"),
    ("GFDL-1.3", rf"gnu free documentation {L}{V}1\.3"),
    ("MPL-1.1", rf"mozilla public {L}{V}1\.1"),
    ("MPL-2.0", rf"mozilla public {L}{V}2(?:\.0)?"),
    ("EPL-1.0", rf"eclipse public {L}{V}1(?:\.0)?"),
    ("EPL-2.0", rf"eclipse public {L}{V}2(?:\.0)?"),
    ("EUPL-1.1", rf"european union public {L}{V}1\.1"),
    ("EUPL-1.2", rf"european union public {L}{V}1\.2"),
    ("CDDL-1.0", rf"common development and distribution {L}{V}1(?:\.0)?"),
    ("CPL-1.0", rf"common public {L}{V}1(?:\.0)?"),
    ("Artistic-1.0", rf"artistic {L}{V}1(?:\.0)?"),
    ("Artistic-2.0", rf"artistic {L}{V}2(?:\.0)?"),
    ("BSL-1.0", rf"boost software {L}{V}1(?:\.0)?"),
    ("OFL-1.1", rf"(?:sil )?open font {L}{V}1\.1"),
    ("OSL-3.0", rf"open software {L}{V}3(?:\.0)?"),
    ("AFL-3.0", rf"academic free {L}{V}3(?:\.0)?"),
    ("ODbL-1.0", rf"open (?:data commons open )?database {L}{V}1(?:\.0)?"),
    ("PSF-2.0", rf"(?:python software foundation|psf) {L}{V}2(?:\.0)?"),
    ("PHP-3.01", rf"php {L}{V}3\.01"),
    ("BSD-2-Clause", rf"(?:simplified|2-clause) bsd {L}|bsd 2-clause {L}"),
    ("BSD-3-Clause", rf"(?:new|modified|revised|3-clause) bsd {L}|bsd 3-clause {L}"),
    ("BSD-4-Clause", rf"(?:original|4-clause) bsd {L}|bsd 4-clause {L}"),
    ("ISC", rf"isc {L}"),
    ("Zlib", rf"zlib {L}"),
    ("PostgreSQL", rf"postgresql {L}"),
    ("NCSA", rf"(?:university of illinois )?ncsa(?: open source)? {L}"),
    ("Unlicense", "unlicense"),
    ("WTFPL", f"wtfpl(?: {L})?"),
)
#: Creative Commons: what the parts and the versions are called.
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_WORDS = {"BY": "attribution", "NC": "non(?:-)?commercial", "SA": "share(?: |-)?alike", "ND": "no(?: |-)?deriv(?:ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
LEAD = rf"(?:(?:this|the) (?:\w+ )?is |it is |and )?(?:dual )?(?:licen[sc]ed|released|distributed|published|(?:made )?available) under (?:the terms of )?(?:the |an? )?"
SENTENCES = (
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MitNotice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdEndorse", r"neither the names? .* may be used to endorse or promote products .* without specific prior written permission"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at.*"),
    ("ApacheUrl", r"https? www\.apache\.org licenses license-2\.0(?:\.txt)?"),
    ("ApacheAsIs", r"unless required by applicable law .* distributed on an as is basis.*"),
    ("GplAs3", r".*redistribute it and or modify it under the terms of the gnu general public license .*version 3.*"),
    ("GplAs2", r".*redistribute it and or modify it under the terms of the gnu general public license .*version 2.*"),
    ("UnlicenseGrant", r"this is free and unencumbered software released into the public domain"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications.*"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("NoWarranty", r".*without any warranty.*"),
    ("AsIs", r"(?:the|this) software is provided .*as is.*"),
    ("PublicDomain", r"(?:this|the) \w+ is (?:in|released into|dedicated to) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"(?:portions )?copyright (?:c )?.*"),
)
RULES = (
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse AsIs?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary AsIs?"),
    ("MIT", "MitGrant MitNotice? AsIs?"),
    ("ISC", "IscGrant AsIs?"),
    ("Zlib", "ZlibGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("Unlicense", "UnlicenseGrant"),
    ("Apache-2.0", "Apache-2.0 ApacheComply? ApacheCopy? ApacheUrl? ApacheAsIs?"),
    ("Apache-2.0", "ApacheComply ApacheCopy ApacheUrl? ApacheAsIs?"),
    ("GPL-3.0", "GplAs3 NoWarranty?"),
    ("GPL-2.0", "GplAs2 NoWarranty?"),
    ("Public-Domain", "PublicDomain"),
    ("Proprietary", "Copyright? AllRights"),
)


def commons() -> list[tuple[str, str]]:
    """Names and patterns of the Creative Commons licences."""
    out = [("CC0-1.0", rf"(?:cc0|creative commons zero)(?:(?: |-)1\.0)?(?: universal)?(?: {L})?")]
    for kind in CC_KINDS:
        parts = kind.split("-")
        short, long = "(?: |-)".join(p.lower() for p in parts), "(?: |-)".join(CC_WORDS[p] for p in parts)
        for v in CC_VERSIONS:
            end = "(?: international| unported| generic)?"
            out.append((f"CC-{kind}-{v}", rf"(?:(?:cc|creative commons)(?: |-){short}|creative commons {long})(?: {L})?(?: |-)(?:version )?v?{v.replace('.', chr(92) + '.')}{end}(?: {L})?"))
    return out


def known() -> tuple[tuple[str, tuple[tuple[str, str], ...]], ...]:
    """Groups of sentences: what a sentence of the group holds, and its identifiers and patterns."""
    under = lambda names: tuple((name, rf"{LEAD}(?:{one})(?: or(?: at your option)? any later version)?(?: the license)?") for name, one in names)
    return ((r"\bcc|commons", under(commons())), ("under", under(NAMES)), ("", SENTENCES))


def wrapped(pattern: str) -> str:
    """The pattern with line ends in the place of blanks, at the end of a unit and from a line's start."""
    return f"(?s)(?:^|\n)(?:{pattern.replace(' ', '[ ' + chr(10) + ']')})$"


def normalised(c: Column) -> Column:
    """Lower case, marks but for inner points and hyphens to blanks; line ends stay."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9.\n-]+", " "), r"\.(?=[ \n]|$)", "")
    return F.regexp_replace(F.regexp_replace(c, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def units(c: Column) -> Column:
    """The parts of a text between blank lines, list items and ends of sentences, without comment leaders."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)^[ \t]*(?://+|#+|/?\*+/?|;+|--+|<!--+|%+|(?:REM|dnl)\b)?[ \t]*", "")
    c = F.regexp_replace(c, r"(?m)^(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|[-\x{2022}])[ \t]+", "\n\n")
    return F.split(c, r"\n\s*\n\s*|(?<=[.;!?])[\s\"')\]]*\s+|(?<=:)[ \t]*\n\s*", -1)


def rule_pattern(sequence: str) -> str:
    """A pattern over identifiers in angle brackets."""
    return "".join(f"(?:<{w.rstrip('?')}>){'?' if w.endswith('?') else ''}".replace(".", r"\.") for w in sequence.split())


def _last(c: Column) -> Column:
    """Struct of the identifier of the known sentence at a unit's end, or null, and the text before it."""
    names = {name.lower(): name for name, _ in (*commons(), *NAMES)}
    tag = r"(?s)(?:^|\n)spdx-license-identifier ([a-z0-9.-]+?)(?:-only|-or-later)?$"
    listed = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.regexp_extract(c, tag, 1))
    found = lambda name, p: F.struct(name.alias("id"), F.regexp_replace(c, p, "").alias("head"))
    none = F.struct(F.lit(None).cast("string").alias("id"), c.alias("head"))

    def chain(groups) -> Column:
        if not groups:
            return none
        (gate, sentences), *rest = groups
        out = F.when(F.lit(False), none)
        for name, one in sentences:
            out = out.when(c.rlike(wrapped(one)), found(F.lit(name), wrapped(one)))
        if not gate:
            return out.otherwise(none)
        own = out.otherwise(none)
        return F.when(c.rlike(gate) & F.get(F.transform(F.array(own), lambda x: x["id"].isNotNull()), F.lit(0)), own).otherwise(chain(rest))

    return F.when(c.contains("spdx") & c.rlike(tag), found(listed, tag)).otherwise(chain(list(known())))


def _let(c: Column, body) -> Column:
    return F.get(F.transform(F.array(c), body), F.lit(0))


def identifiers(c: Column) -> Column:
    """The identifiers of a unit, - for other lines."""
    line = lambda x: F.coalesce(_let(_last(x), lambda f: f["id"]), F.lit("-"))
    heads = lambda head: F.when(head == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(head, "\n"), line))
    several = lambda n, f: F.when(f["id"].isNull() & ~n.contains("\n"), F.array(F.lit("-"))).otherwise(F.concat(heads(f["head"]), F.when(f["id"].isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array(f["id"]))))
    return _let(normalised(c), lambda n: F.when(~n.rlike(CUE), F.array(F.lit("-"))).otherwise(_let(_last(n), lambda f: several(n, f))))


def licences(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, n_sentences (known ones) and licences array<struct<licence, n>>, sorted by licence."""
    body = F.when(F.lower(text).rlike(CUE), F.col(text)).otherwise("")
    marks = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.flatten(F.transform(units(body), identifiers)).alias("_ids"))
    rows = marks.select("*", F.size(F.filter("_ids", lambda i: i != "-")).cast("long").alias("n_sentences"), F.regexp_replace(F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">")), "(?:<->)+", "<->").alias("_seq"))
    for number, (_, sequence) in enumerate(RULES):
        pattern = rule_pattern(sequence)
        rows = rows.withColumn(f"_n{number}", F.regexp_count("_seq", F.lit(pattern))).withColumn("_seq", F.regexp_replace("_seq", pattern, "<=>"))
    # A name that no rule has taken is a licence by itself.
    alone = [F.lit(name) for name, _ in (*commons(), *NAMES)]
    named = F.filter(F.regexp_extract_all("_seq", F.lit("<([^<>]+)>"), F.lit(1)), lambda i: i.isin(alone))
    every = F.concat(*[F.array_repeat(F.lit(name), F.col(f"_n{number}")) for number, (name, _) in enumerate(RULES)], named)
    rows = rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_sentences", every.alias("_all"))
    each = F.transform(F.array_sort(F.array_distinct("_all")), lambda x: F.struct(x.alias("licence"), F.size(F.filter("_all", lambda y: y == x)).cast("long").alias("n")))
    return rows.select(*keep, "n_sentences", each.alias("licences"))
