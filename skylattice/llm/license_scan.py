"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes a string of its normalised words, each between blanks. Rules are regular expressions over that string;
they know the names of licenses, in several forms, their short identifiers, and the wording of license texts and notices. A
rule is tried only if its keyword is contained, and a text at all only if it has one of a few words. A
detection is an interval of words. Sorted by start, longest first, an interval lies within an earlier one exactly if
the furthest end so far is not before its own, so one pass with a furthest end for each priority decides which are
suppressed: those within another of a better priority, or of the same priority and longer or of an earlier rule.
Everything happens within a row: nothing is shuffled and no pairs of detections are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Phrases whose places are counted, and their labels. Never suppressed.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Label, keyword that every match holds, pattern of the name over single-spaced lower-case words, and the
#: words of its short identifier.
NAMES = [
    ("gpl-1.0", "general public license", "gnu general public license (?:v|v |version )1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public license", "gnu general public license (?:v|v |version )2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public license", "gnu general public license (?:v|v |version )3(?: 0)?", "gpl 3 0"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:v|v |version )2(?: 0)?", "gpl 2 0 only"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:v|v |version )3(?: 0)?", "gpl 3 0 only"),
    ("gpl-2.0+", "general public license", "gnu general public license (?:v|v |version )2(?: 0)? or (?:any )?later", "gpl 2 0 or later"),
    ("gpl-3.0+", "general public license", "gnu general public license (?:v|v |version )3(?: 0)? or (?:any )?later", "gpl 3 0 or later"),
    ("lgpl", "lesser general public", "(?:gnu )?(?:lesser|library) general public license", "lgpl 2 0"),
    ("lgpl-2.1", "lesser general public", "(?:gnu )?lesser general public license (?:v|v |version )2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser general public", "(?:gnu )?lesser general public license (?:v|v |version )3(?: 0)?", "lgpl 3 0"),
    ("agpl", "affero", "(?:gnu )?affero general public license", "agpl 1 0"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license (?:v|v |version )3(?: 0)?", "agpl 3 0"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation license(?: version 1 [123])?", "gfdl 1 3"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license (?:v|v |version )?2(?: 0)?", "apache 2 0"),
    ("mit", "mit license", "(?:the )?mit license", "mit"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?", "mit 0"),
    ("x11", "x11 license", "x11 license", "x11"),
    ("bsd-2-clause", "bsd", "(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:4 clause bsd|bsd 4 clause|original bsd)(?: license)?", "bsd 4 clause"),
    ("bsd", "bsd", "bsd (?:style )?license", "0bsd"),
    ("isc", "isc license", "isc license", "isc"),
    ("mpl-1.1", "mozilla public license", "mozilla public license (?:v|v |version )1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public license", "mozilla public license (?:v|v |version )2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla public license", "mozilla public license", "mpl 1 0"),
    ("epl-1.0", "eclipse public license", "eclipse public license (?:v|v |version )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse public license", "eclipse public license (?:v|v |version )?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse public license", "eclipse public license", "epl"),
    ("cddl", "common development and distribution", "common development and distribution license(?: version 1 [01])?", "cddl 1 0"),
    ("cpl", "common public license", "common public license(?: version 1 0)?", "cpl 1 0"),
    ("eupl", "european union public", "european union public licen[cs]e(?: v 1 [12])?", "eupl 1 2"),
    ("artistic", "artistic license", "artistic license(?: (?:version )?[12] 0)?", "artistic 2 0"),
    ("zlib", "zlib license", "zlib(?: libpng)? license", "zlib"),
    ("boost", "boost software license", "boost software license(?: version 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "public license", "do what the fuck you want to public license", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "creative commons attribution", "creative commons attribution(?: [1-4] 0)?(?: (?:international|unported))?(?: license)?", "cc by 4 0"),
    ("cc-by-3.0", "cc by", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc by", "cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution share ?alike(?: [1-4] 0)?(?: (?:international|unported))?(?: license)?", "cc by sa 3 0"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] 0)?", "cc by sa 4 0"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution non ?commercial(?: [1-4] 0)?(?: (?:international|unported))?(?: license)?", "cc by nc 3 0"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] 0)?", "cc by nc 4 0"),
    ("cc-by-nd", "creative commons attribution", "creative commons attribution no ?deriv(?:atives|s)(?: [1-4] 0)?(?: license)?", "cc by nd 3 0"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] 0)?", "cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] 0)?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] 0)?", "cc by nc nd 4 0"),
    ("cc", "creative commons", "creative commons license", "cc pddc"),
    ("public-domain", "public domain", "(?:placed |released |dedicated )?(?:in|into|to) the public domain", "public domain"),
    ("odbl", "open database license", "open database license(?: v 1 0)?", "odbl 1 0"),
    ("ofl", "open font license", "(?:sil )?open font license(?: version 1 1)?", "ofl 1 1"),
    ("afl", "academic free license", "academic free license(?: (?:v|v |version )[123] [01])?", "afl 3 0"),
    ("osl", "open software license", "open software license(?: (?:v|v |version )[123] [01])?", "osl 3 0"),
    ("ms-pl", "microsoft public license", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license", "ms rl"),
    ("python", "python software foundation", "python software foundation license(?: version 2)?", "psf 2 0"),
    ("php", "php license", "php license(?: version 3 0[01])?", "php 3 01"),
    ("postgresql", "postgresql license", "postgresql license", "postgresql"),
    ("ruby", "ruby license", "(?:the )?ruby license", "ruby"),
    ("sleepycat", "sleepycat", "sleepycat license", "sleepycat"),
    ("openssl", "openssl license", "openssl license", "openssl"),
    ("ntp", "ntp license", "ntp license", "ntp"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"),
    ("vim", "vim license", "vim license", "vim"),
    ("w3c", "w3c", "w3c software(?: notice and)? license", "w3c"),
    ("elastic", "elastic license", "elastic license(?: 2 0)?", "elastic 2 0"),
    ("sspl", "server side public", "server side public license(?: v ?1)?", "sspl 1 0"),
    ("busl", "business source license", "business source license(?: 1 1)?", "busl 1 1"),
    ("ecl", "educational community license", "educational community license(?: version 2 0)?", "ecl 2 0"),
    ("upl", "universal permissive license", "universal permissive license(?: 1 0)?", "upl 1 0"),
    ("mulan", "mulan", "mulan (?:psl|permissive software license)(?: v ?2)?", "mulanpsl 2 0"),
    ("proprietary", "all rights reserved", "all rights reserved", "licenseref proprietary"),
]
#: What stands before or after a name, its priority (a smaller one is better) and confidence.
FORMS = [
    ("{name}", 3, 0.6),
    ("(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}", 2, 0.9),
    ("{name} (?:agreement|terms and conditions|notice)", 2, 0.7),
    ("subject to (?:the )?(?:terms of (?:the )?)?{name}", 2, 0.8),
]
#: Wording of licenses and their notices: label, keyword that every match holds, pattern, confidence.
WORDING = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    ("mit", "to deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 0.95),
    ("mit", "this permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.6),
    ("x11", "except as contained in this notice", "except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising", 0.9),
    ("hpnd", "permission to use copy modify", "permission to use copy modify (?:and )?distribute and sell this software and its documentation for any purpose is hereby granted without fee", 0.95),
    ("hpnd", "supporting documentation", "that copyright notice and this permission notice appear in supporting documentation", 0.85),
    ("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "this permission notice appear", "provided that the above copyright notice and this permission notice appear in all copies", 0.85),
    ("isc", "disclaims all warranties", "the author disclaims all warranties with regard to this software", 0.75),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.85),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 0.85),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 0.8),
    ("bsd", "regents", "this software is provided by the regents and contributors as is and any express or implied warranties", 0.85),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[^ ]+ ){1,16}may be used to endorse or promote products derived from this software", 0.95),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 0.8),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.99),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0(?: txt| html)?", 0.9),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2.0", "contributor hereby grants", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 0.95),
    ("gpl", "free software you can redistribute", "(?:[^ ]+ )is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "hope that it will be useful", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.9),
    ("gpl", "received a copy of the gnu general", "you should have received a copy of the gnu general public license along with", 0.9),
    ("gpl-2.0", "general public license as published", "gnu general public license as published by the free software foundation version 2(?: of the license)?", 0.99),
    ("gpl-3.0", "general public license as published", "gnu general public license as published by the free software foundation version 3(?: of the license)?", 0.99),
    ("gpl-2.0", "general public license version 2 as published", "gnu general public license version 2 as published by the free software foundation", 0.99),
    ("gpl-2.0+", "general public license as published", "gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version", 0.99),
    ("gpl-3.0+", "general public license as published", "gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0.99),
    ("gpl-2.0", "version 2 june 1991", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-3.0", "version 3 29 june 2007", "gnu general public license version 3 29 june 2007", 1.0),
    ("gpl", "licenses for most software", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", 0.95),
    ("lgpl", "lesser general public", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("lgpl", "library general public", "gnu library general public license(?: as published by the free software foundation)?", 0.8),
    ("lgpl-2.1+", "lesser general public license as published", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version", 0.99),
    ("lgpl-3.0+", "lesser general public license as published", "gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0.99),
    ("lgpl-2.1", "version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("agpl-3.0+", "affero general public license as published", "gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0.99),
    ("agpl-3.0", "version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("agpl", "network server", "ensure that in such cases the modified source code becomes available to the community(?: [^ ]+){0,8} network server", 0.7),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.99),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.99),
    ("mpl-2.0", "a copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.95),
    ("mpl-1.1", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1", 0.99),
    ("mpl-1.0", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 0", 0.99),
    ("npl", "netscape public license", "the contents of this file are subject to the netscape public license(?: version 1 [01])?", 0.99),
    ("epl-1.0", "eclipse public license", "made available under the terms of the eclipse public license v1 0", 0.99),
    ("epl-2.0", "eclipse public license", "made available under the terms of the eclipse public license (?:v )?2 0", 0.99),
    ("epl", "eclipse public license", "the accompanying program is provided under the terms of this eclipse public license", 0.95),
    ("cddl", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license", 0.99),
    ("cpl", "common public license", "the accompanying program is provided under the terms of this common public license", 0.95),
    ("eupl", "european union public", "licensed under the eupl(?: version 1 [012])?(?: or as soon they will be approved by the european commission)?|european union public licence v 1 [012]", 0.9),
    ("artistic", "artistic license", "you can redistribute it and or modify it under the (?:same )?terms (?:as perl itself|of the artistic license)", 0.9),
    ("perl", "same terms as perl", "under the same terms as perl(?: itself)?", 0.9),
    ("artistic", "standard version of this package", "verbatim copies of the (?:source form of the )?standard version of this package without restriction", 0.9),
    ("zlib", "in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.95),
    ("boost", "boost software license", "distributed under the boost software license version 1 0", 0.99),
    ("boost", "executable object code", "machine executable object code generated by a source language processor", 0.9),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 0.99),
    ("wtfpl", "you just do what", "you just do what the fuck you want to", 0.99),
    ("cc0", "copyright and related rights", "(?:has )?waived all copyright and related (?:or|and) neighboring rights", 0.9),
    ("cc0", "no copyright", "the person who associated a work with this deed has dedicated the work to the public domain", 0.9),
    ("cc", "creative commons", "this work is licensed under (?:a|the) creative commons", 0.9),
    ("cc-by-4.0", "creativecommons org licenses", "creativecommons org licenses by 4 0", 0.95),
    ("cc-by-3.0", "creativecommons org licenses", "creativecommons org licenses by 3 0", 0.95),
    ("cc-by-sa", "creativecommons org licenses", "creativecommons org licenses by sa [1-4] [05]", 0.95),
    ("cc-by-nc", "creativecommons org licenses", "creativecommons org licenses by nc [1-4] [05]", 0.95),
    ("cc-by-nd", "creativecommons org licenses", "creativecommons org licenses by nd [1-4] [05]", 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses", "creativecommons org licenses by nc sa [1-4] [05]", 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses", "creativecommons org licenses by nc nd [1-4] [05]", 0.95),
    ("cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0", 0.95),
    ("openssl", "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young", 0.95),
    ("php", "php license", "this source file is subject to version [23] [0-9]+ of the php license", 0.99),
    ("python", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization", 0.99),
    ("ofl", "font software", "this font software is licensed under the sil open font license", 0.99),
    ("ofl", "font software", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 0.95),
    ("postgresql", "university of california be liable", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", 0.85),
    ("curl", "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("ncsa", "to deal with the software", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute", 0.95),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", 0.99),
    ("json", "used for good", "the software shall be used for good not evil", 0.99),
    ("sspl", "making the functionality of the program", "making the functionality of the program or modified version available to third parties as a service", 0.9),
    ("busl", "change date", "on the change date(?: [^ ]+){0,12} the licensor hereby grants you rights under the terms of the change license", 0.9),
    ("commons-clause", "commons clause", "commons clause (?:license )?condition", 0.95),
    ("upl", "larger works", "the larger works to which the software is contributed by such licensors", 0.9),
    ("ms-pl", "microsoft public license", "this license governs use of the accompanying software(?: [^ ]+){0,20} microsoft public license", 0.9),
    ("public-domain", "public domain", "(?:this (?:file|code|software|work|program) )?(?:is|has been) (?:hereby )?(?:placed |released )?(?:in|into) the public domain", 0.9),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code", 0.95),
    ("warranty", "without warranty", "(?:provided |distributed )?as is without (?:any )?warranty of any kind", 0.3),
    ("warranty", "fitness for a particular purpose", "merchantability (?:and |or )?(?:and )?fitness for a particular purpose", 0.3),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 0.7),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|reproduction|use)(?: [^ ]+){0,12} is strictly prohibited", 0.8),
    ("proprietary", "trade secret", "contains (?:confidential information and )?trade secrets? of", 0.7),
]
#: A text that in lower case has none of these has no detection; each rule's keyword holds one of them.
GATE = (
    "licen", "apache", "received a copy", "spdx", "gpl", "bsd", "affero", "mit", "cc0", "creative", "public", "reserved", "mulan", "sleepycat", "ncsa", "w3c", "cc",
    "permission", "software", "warrant",
    "merchantab", "distribut", "copyright", "documentation", "regents", "contributor", "applicable law",
    "hope that", "june", "february", "november", "network server", "the mpl", "the authors", "altered", "executable", "do what", "openssl",
    "eric young", "university", "beer", "for good", "program", "change date", "commons", "larger works", "perl", "fitness", "confidential",
    "prohibited", "trade secret", "package", "advertising", "endorse", "this notice", "source code",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(pattern: str) -> str:
    """A pattern over single-spaced words, for words that each have a blank on both sides."""
    return " (" + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "


def rules() -> list[tuple[int, str, str, int, float, str, bool]]:
    """number, label, keyword, priority, confidence, pattern, base; in order of precedence."""
    out = [(label, phrase, 0, 0.8, phrase, True) for label, phrase in BASE]
    out += [(label, "spdx", 1, 1.0, f"spdx license identifier {short}", False) for label, _, _, short in NAMES]
    out += [(label, key, 2, sure, pattern, False) for label, key, pattern, sure in WORDING]
    out += [(label, key, prio, sure, form.format(name=name), False) for form, prio, sure in FORMS for label, key, name, _ in NAMES]
    return [(i, label, key.replace(" ", "  "), prio, sure, spaced(p), base) for i, (label, key, prio, sure, p, base) in enumerate(out)]


def normalised(text: Column) -> Column:
    """Words in lower case (A-Z), each between blanks."""
    low = F.translate(text, UPPER, LOWER)
    words = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")
    return F.concat(F.lit(" "), F.regexp_replace(words, "^ +| +$", ""), F.lit(" "))


def detections(norm: Column) -> Column:
    """Sorted array of (start, back, priority, number, label, confidence, base); back is minus the end; end is exclusive."""
    fields = ("number", "label", "keyword", "priority", "confidence", "pattern", "base")
    by_keyword: dict[str, list[Column]] = {}
    for rule in rules():
        by_keyword.setdefault(rule[2], []).append(F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, rule)]))

    def found(rule):
        # the first word of each match is marked, so that its number is that of a marked word
        marked = F.split(F.trim(F.regexp_replace(norm, rule["pattern"], F.lit(" \u0001$1 "))), "  ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i)), lambda i: i.isNotNull())
        sizes = F.transform(F.regexp_extract_all(norm, rule["pattern"], F.lit(1)), lambda m: F.size(F.split(m, "  ")))
        return F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (-(s + n)).alias("back"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))

    # each keyword is looked for once, whatever the number of its rules
    none = F.array().cast(f"array<{RULE}>")
    active = F.flatten(F.array(*[F.when(F.contains(norm, F.lit(key)), F.array(*own)).otherwise(none) for key, own in by_keyword.items()]))
    hits = F.filter(active, lambda r: F.call_function("rlike", norm, r["pattern"]))
    return F.array_sort(F.flatten(F.transform(hits, found)))


RULE = "struct<number:int,label:string,keyword:string,priority:int,confidence:double,pattern:string,base:boolean>"
BLOCK = 2048


def kept(sorted_: Column, kind: str) -> Column:
    """The array, of type kind, without suppressed detections.

    The pass carries the furthest end for each priority and one byte for each detection of a block; blocks are filtered
    as they end, so that what is copied in a step does not grow with the detections.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sorted_) - 1) / BLOCK).cast("int")), lambda b: F.slice(sorted_, b * BLOCK + 1, F.lit(BLOCK)))
    priorities = range(4)

    def step(acc, d):
        end = -d["back"]
        better = F.lit(False)
        for p in priorities:
            better |= (d["priority"] >= p) & (acc[f"e{p}"] >= end)
        ends = [F.when(d["priority"] == p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in priorities]
        return F.struct(*ends, F.concat(acc["flags"], F.when(better & ~d["base"], F.lit(b"0")).otherwise(F.lit(b"1"))).alias("flags"))

    def of_block(acc, block):
        start = F.struct(*[acc[f"e{p}"].alias(f"e{p}") for p in priorities], F.lit(b"").alias("flags"))
        left = lambda flags: F.filter(block, lambda d, i: F.substring(flags, i + 1, F.lit(1)) == F.lit(b"1"))
        return F.aggregate(block, start, step, lambda a: F.struct(*[a[f"e{p}"].alias(f"e{p}") for p in priorities], F.concat(acc["out"], left(a["flags"])).alias("out")))

    first = F.struct(*[F.lit(-1).alias(f"e{p}") for p in priorities], F.array().cast(kind).alias("out"))
    return F.aggregate(blocks, first, of_block, lambda acc: acc["out"])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are numbered from 0. score is the highest confidence of a kept detection, 0 without any. Null and empty texts
    have no words and no detections; repeated rows stay repeated; an empty table gives an empty table; columns other
    than doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    n_words = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    low, gate = F.lower(text), F.lit(False)
    for word in GATE:
        gate |= F.contains(low, F.lit(word))
    step = docs.select("doc_id", n_words.alias("n_words"), F.when(gate, normalised(text)).alias("norm"))
    step = step.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), detections(F.col("norm"))).alias("found"))
    step = step.select("doc_id", "n_words", "found", F.when(F.size("found") > 0, kept(F.col("found"), step.schema["found"].dataType.simpleString())).alias("kept"))
    base = F.filter("found", lambda d: d["base"])
    labels = lambda a: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ","), F.lit(""))
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return step.select(
        "doc_id", "n_words",
        F.greatest(F.size(F.coalesce(base, F.array().cast(step.schema["found"].dataType))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["number"].alias("rule"))).alias("detections"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base places, labels and score of all documents; see license_scan for the cases."""
    return license_scan(read(spark, sf_dir, "documents")).drop("detections")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP7_SQL = rf"""
with rules(number, label, keyword, priority, confidence, pattern, base) as (values {", ".join(f"({i}, {quoted(a)}, {quoted(k)}, {p}, {c}, {quoted(x)}, {str(b).lower()})" for i, a, k, p, c, x, b in rules())}),
d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
n as (select *, ' ' || array_to_string(ws, '  ') || ' ' norm from d),
hit as (
  select r, rules.*, string_split(trim(regexp_replace(norm, pattern, ' ' || chr(1) || '\1 ', 'g')), '  ') marked, regexp_extract_all(norm, pattern, 1) matches
  from n join rules on contains(norm, keyword) where regexp_matches(norm, pattern)),
places as (
  select * exclude (marked, matches), list_filter(range(len(marked)), lambda i: marked[i + 1][1] = chr(1)) starts, list_transform(matches, lambda m: len(string_split(m, '  '))) sizes from hit),
det as (
  select r, number, label, priority, confidence, base, unnest(starts) s, unnest(sizes) z from places),
ends as (
  select *, {", ".join(f"max(case when priority <= {p} then s + z else -1 end) over (partition by r order by s, s + z desc, priority, number rows between unbounded preceding and 1 preceding) e{p}" for p in range(4))} from det),
kept as (select *, base or coalesce(case priority when 0 then e0 when 1 then e1 when 2 then e2 else e3 end, -1) < s + z ok from ends),
agg as (
  select r, count(*) filter (base) n_base, min(s) filter (base) first_word, max(s) filter (base) last_word,
    string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) filter (ok) labels,
    max(confidence) filter (ok) score
  from kept group by r)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_base, 0) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, cast(coalesce(score, 0) as double) score
from d left join agg using (r)
"""
