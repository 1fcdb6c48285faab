"""License scan by ordered signature rules, with DataFrame functions alone.

A rule is a regular expression over a text's words (lower case, one blank between two words) with
a keyword, a priority, a label and a confidence. Signatures of license texts and headers are written out one by one;
names and identifiers are written once and stand in a few contexts each. A text is looked at only if it holds one
of a few needles; a rule is tried only if the text holds its keyword, a string that every match contains. Every pattern is a
literal of its own expression, so it is compiled once a task. Every match is an interval of words. A match within an
interval of a higher priority, or within a longer one of the same priority, is suppressed; a weak match (priority 0)
stands only where nothing else does. Base phrases are found exactly as stated and are never suppressed.

No step shuffles: everything happens within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.columns import let

from .common import table, text_of

#: What separates words: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def version(*numbers: str) -> str:
    """A version after a name, glued to it or not: v2, 2 0, version 2, v 2 0. The numbers after the first may be left out."""
    return "(?: license| licence)?(?: version| v)? ?v?" + numbers[0] + "".join(f"(?: {n})?" for n in numbers[1:])


LATER = "(?: only| or later| or newer| or any later version)?"
GPL = "(?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?"
LGPL = "(?:gnu )?(?:lesser|library)(?: or library)? general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?"
AGPL = "(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: as published by the free software foundation)?(?: either)?"

#: Names: label, keyword, pattern. Each stands in every one of CONTEXTS.
NAMES = (
    ("mit", "mit", "mit(?: x11| expat)?"),
    ("mit", "expat", "expat"),
    ("mit", "x11", "x11"),
    ("apache-1", "apache", "apache(?: software)?" + version("1", "[01]")),
    ("apache-2", "apache", "apache(?: software)?" + version("2", "0")),
    ("apache-2", "asl", "asl" + version("2", "0")),
    ("gpl-1", "gpl", "(?:gnu )?gpl" + version("1", "0") + LATER),
    ("gpl-2", "gpl", "(?:gnu )?gpl" + version("2", "0") + LATER),
    ("gpl-3", "gpl", "(?:gnu )?gpl" + version("3", "0") + LATER),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl-1", "general public", GPL + version("1", "0") + LATER),
    ("gpl-2", "general public", GPL + version("2", "0") + LATER),
    ("gpl-3", "general public", GPL + version("3", "0") + LATER),
    ("lgpl-2", "lgpl", "(?:gnu )?lgpl" + version("2", "[01]") + LATER),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl" + version("3", "0") + LATER),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl-2", "general public", LGPL + version("2", "[01]") + LATER),
    ("lgpl-3", "general public", LGPL + version("3", "0") + LATER),
    ("agpl-3", "agpl", "(?:gnu )?agpl" + version("3", "0") + LATER),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("agpl-3", "affero", AGPL + version("3", "0") + LATER),
    ("fdl-1", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version)?(?: 1 [123])?"),
    ("fdl-1", "gfdl", "(?:gnu )?gfdl(?: version)?(?: v?1 [123])?"),
    ("bsd-2", "simplified", "simplified bsd"),
    ("bsd-2", "bsd", "(?:bsd 2(?: clause)?|(?:2|two) clause bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:bsd 3(?: clause)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4(?: clause)?|(?:4|four) clause bsd|original bsd)"),
    ("bsd-0", "bsd", "(?:0bsd|(?:zero|0) clause bsd|bsd zero clause)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("isc", "isc", "isc"),
    ("mpl-1", "mozilla", "mozilla public" + version("1", "[01]")),
    ("mpl-2", "mozilla", "mozilla public" + version("2", "0")),
    ("mpl-1", "mpl", "mpl" + version("1", "[01]")),
    ("mpl-2", "mpl", "mpl" + version("2", "0")),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1", "eclipse", "eclipse public" + version("1", "0")),
    ("epl-2", "eclipse", "eclipse public" + version("2", "0")),
    ("epl-1", "epl", "epl" + version("1", "0")),
    ("epl-2", "epl", "epl" + version("2", "0")),
    ("edl-1", "eclipse", "eclipse distribution(?: licen[cs]e)?(?: version)?(?: v? ?1(?: 0)?)?"),
    ("cpl-1", "common public", "common public(?: licen[cs]e)?(?: version)?(?: v? ?1(?: 0)?)?"),
    ("ipl-1", "ibm public", "ibm public(?: licen[cs]e)?(?: version)?(?: v? ?1(?: 0)?)?"),
    ("cddl-1", "cddl", "cddl(?: version)?(?: v? ?1 [01])?"),
    ("cddl-1", "development and distribution", "common development and distribution(?: licen[cs]e)?(?: cddl)?(?: version)?(?: v? ?1 [01])?"),
    ("artistic-1", "artistic", "(?:perl )?artistic" + version("1", "0")),
    ("artistic-2", "artistic", "(?:perl )?artistic" + version("2", "0")),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version| v)?(?: 2)?"),
    ("wtfpl", "what the", "do what the (?:fuck|f) you want to public"),
    ("boost-1", "boost", "boost(?: software)?(?: licen[cs]e)?(?: version)?(?: v? ?1 0)?"),
    ("python-2", "python", "python(?: software foundation)?(?: licen[cs]e)?(?: version)?(?: 2(?: 0)?)?"),
    ("php-3", "php", "php(?: licen[cs]e)?(?: version)?(?: v)? ?3(?: 0[01]?)?"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl(?: ssleay)?"),
    ("ofl-1", "ofl", "(?:sil )?ofl(?: version)?(?: v? ?1 [01])?"),
    ("ofl-1", "open font", "(?:sil )?open font(?: licen[cs]e)?(?: version)?(?: v? ?1 [01])?"),
    ("eupl-1", "eupl", "eupl(?: version)?(?: v? ?1 [012])?"),
    ("eupl-1", "european union public", "european union public(?: licen[cs]e)?(?: version)?(?: v? ?1 [012])?"),
    ("cecill", "cecill", "cecill(?: [bc])?(?: version)?(?: 2 [01])?"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal"),
    ("upl-1", "universal permissive", "universal permissive(?: licen[cs]e)?(?: version)?(?: v? ?1 0)?"),
    ("afl-3", "academic free", "academic free(?: licen[cs]e)?(?: version)?(?: v? ?3 0)?"),
    ("osl-3", "open software", "open software(?: licen[cs]e)?(?: version)?(?: v? ?3 0)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?(?:ncsa )?(?:uiuc )?ncsa(?: open source)?"),
    ("sspl-1", "sspl", "sspl(?: version)?(?: v? ?1(?: 0)?)?"),
    ("sspl-1", "server side public", "server side public(?: licen[cs]e)?(?: version)?(?: v? ?1(?: 0)?)?"),
    ("elastic-2", "elastic", "elastic" + version("2", "0")),
    ("busl-1", "business source", "business source(?: licen[cs]e)?(?: version)?(?: 1 1)?"),
    ("bsl-1", "bsl", "bsl(?: version)?(?: 1 0)?"),
    ("odbl-1", "odbl", "odbl(?: version)?(?: v? ?1 0)?"),
    ("odbl-1", "open database", "open database(?: licen[cs]e)?(?: odbl)?(?: version)?(?: v? ?1 0)?"),
    ("odc-by-1", "open data commons", "open data commons attribution(?: licen[cs]e)?(?: version)?(?: v? ?1 0)?"),
    ("pddl-1", "public domain dedication and", "(?:open data commons )?public domain dedication and(?: licen[cs]e)?"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1", "creative commons", "creative commons(?: cc0| zero)(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
    ("proprietary", "proprietary", "proprietary"),
    ("commercial", "commercial", "commercial"),
)
#: How a text names its license: pattern around the name, priority, confidence.
CONTEXTS = (
    ("(?:(?:re)?(?:licensed|licenced|released|distributed|published|offered|provided|available|covered|use|used|usage|shared) )?under (?:the )?(?:terms (?:and conditions )?of (?:the |a )?)?{}(?: licen[cs]e)?", 4, 0.95),
    ("(?:spdx )?licen[cs]e(?: identifier| type| name| info| id| is)? (?:the )?{}(?: licen[cs]e)?", 4, 0.95),
    ("{} licen[cs]e(?! (?:plates?|keys?|numbers?|fees?)(?![^ ]))", 3, 0.8),
)
#: Names that are common words too: "under" alone before them says nothing, it takes a verb, terms or a license word.
COMMON = ("mit", "expat", "x11", "isc", "ruby", "python-2", "boost-1", "artistic", "zlib", "libpng", "openssl", "postgresql", "ncsa", "proprietary", "commercial")
COMMON_UNDER = (
    "(?:(?:(?:re)?(?:licensed|licenced|released|distributed|published|offered|provided|available|covered|shared) under (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?|under (?:the )?terms (?:and conditions )?of (?:the |an? )?){}(?: licen[cs]e)?"
    "|(?:use|used|usage) under (?:the |an? )?{} licen[cs]e|under (?:the |an? )?{} licen[cs]e)"
)
#: "commercial license" alone may be what somebody must buy.
COMMERCIAL = "commercial licen[cs]e agreement"
#: Identifiers that name a license wherever they stand: label, keyword, pattern.
IDENTIFIERS = (
    ("apache-2", "apache", "apache 2 0"), ("apache-1", "apache", "apache 1 [01]"),
    ("gpl-1", "gpl", "gpl 1 0(?: only| or later)?"), ("gpl-2", "gpl", "gpl 2 0(?: only| or later)?"), ("gpl-3", "gpl", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gplv2", "gplv2"), ("gpl-3", "gplv3", "gplv3"), ("lgpl-2", "lgplv2", "lgplv2(?: 1)?"), ("lgpl-3", "lgplv3", "lgplv3"), ("agpl-3", "agplv3", "agplv3"),
    ("lgpl-2", "lgpl", "lgpl 2 [01](?: only| or later)?"), ("lgpl-3", "lgpl", "lgpl 3 0(?: only| or later)?"), ("agpl-3", "agpl", "agpl 3 0(?: only| or later)?"),
    ("bsd-2", "bsd", "bsd 2 clause(?: patent| views)?"), ("bsd-3", "bsd", "bsd 3 clause(?: clear| attribution)?"), ("bsd-4", "bsd", "bsd 4 clause"), ("bsd-0", "0bsd", "0bsd"),
    ("mpl-1", "mpl", "mpl 1 [01]"), ("mpl-2", "mpl", "mpl 2 0"), ("epl-1", "epl", "epl 1 0"), ("epl-2", "epl", "epl 2 0"), ("cddl-1", "cddl", "cddl 1 [01]"),
    ("boost-1", "bsl", "bsl 1 0"), ("busl-1", "busl", "busl 1 1"), ("artistic-1", "artistic", "artistic 1 0"), ("artistic-2", "artistic", "artistic 2 0"), ("eupl-1", "eupl", "eupl 1 [012]"),
    ("ofl-1", "ofl", "ofl 1 [01]"), ("cc0-1", "cc0", "cc0 1 0"), ("cc-by", "cc by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa", "cc by sa [1-4] [05]"), ("cc-by-nd", "cc by nd", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc", "cc by nc [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa [1-4] [05]"), ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd [1-4] [05]"),
    ("odbl-1", "odbl", "odbl 1 0"), ("python-2", "psf", "psf 2 0"), ("php-3", "php", "php 3 0[01]?"), ("upl-1", "upl", "upl 1 0"), ("sspl-1", "sspl", "sspl 1 0"), ("ms-pl", "ms pl", "ms pl"), ("ms-rl", "ms rl", "ms rl"),
    ("wtfpl", "wtfpl", "wtfpl"), ("unlicense", "unlicense", "unlicense"), ("postgresql", "postgresql licen", "postgresql licence"),
    ("gpl-classpath", "classpath exception", "classpath exception(?: 2 0)?"), ("proprietary", "proprietary", "(?:now|became|becomes|remains) proprietary"),
)
#: Full names with a version, wherever they stand: label, keyword, pattern.
VERSIONED = (
    ("mpl-1", "mozilla public", "mozilla public licen[cs]e(?: mpl)?" + version("1", "[01]")), ("mpl-2", "mozilla public", "mozilla public licen[cs]e(?: mpl)?" + version("2", "0")),
    ("apache-1", "apache", "apache(?: software)? licen[cs]e" + version("1", "[01]")), ("apache-2", "apache", "apache(?: software)? licen[cs]e" + version("2", "0")),
    ("gpl-1", "general public", GPL + version("1", "0") + LATER), ("gpl-2", "general public", GPL + version("2", "0") + LATER), ("gpl-3", "general public", GPL + version("3", "0") + LATER),
    ("lgpl-2", "general public", LGPL + version("2", "[01]") + LATER), ("lgpl-3", "general public", LGPL + version("3", "0") + LATER), ("agpl-3", "affero", AGPL + version("3", "0") + LATER),
    ("epl-1", "eclipse public", "eclipse public licen[cs]e(?: epl)?" + version("1", "0")), ("epl-2", "eclipse public", "eclipse public licen[cs]e(?: epl)?" + version("2", "0")),
)
#: Texts that are nothing but an identifier.
ALONE = (("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("ruby", "ruby"), ("openssl", "openssl"), ("libpng", "libpng"), ("ncsa", "ncsa"), ("x11", "x11"), ("cc0-1", "cc0"))
#: Signatures of license texts, headers and notices: label, keyword, pattern, priority, confidence.
SIGNATURES = (
    ("mit", "granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6, 1.0),
    ("mit", "granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 5, 0.95),
    ("mit", "without limitation the rights", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 6, 1.0),
    ("mit", "substantial portions", "(?:the above|this) copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", 6, 0.95),
    ("mit-0", "granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 7, 1.0),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", 6, 1.0),
    ("isc", "with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 5, 0.95),
    ("bsd-0", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 7, 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 5, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 5, 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 5, 0.9),
    ("bsd-3", "endorse or promote", "neither the names? of (?:the )?(?:[^ ]+ ){1,8}(?:nor|or) the names of (?:its|the|any) contributors may be used to endorse or promote products", 6, 1.0),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 6, 1.0),
    ("bsd-3-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 6, 1.0),
    ("bsd-2-patent", "patent", "redistribution and use in source and binary forms with or without modification are permitted provided that (?:[^ ]+ ){1,200}perpetual worldwide non exclusive no charge royalty free irrevocable patent license", 7, 0.95),
    ("apache-2", "apache license", "apache license version 2 0 january 2004", 6, 1.0),
    ("apache-2", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 6, 1.0),
    ("apache-2", "licenses license 2 0", "(?:http |https )?(?:www )?apache org licenses license 2 0(?: txt| html)?", 6, 1.0),
    ("apache-2", "without warranties or conditions", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 5, 0.9),
    ("apache-2", "apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements", 6, 1.0),
    ("apache-1", "apache software foundation", "this product includes software developed by the apache software foundation", 5, 0.8),
    ("apache-1", "apache group", "this product includes software developed by the apache group", 5, 0.9),
    ("gpl", "free software you can redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu general public license", 4, 0.9),
    ("gpl-2", "either version 2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 6, 1.0),
    ("gpl-3", "either version 3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 6, 1.0),
    ("gpl-2", "version 2 of the license", "gnu general public license (?:as published by the free software foundation )?version 2 of the license", 6, 0.95),
    ("gpl-3", "version 3 of the license", "gnu general public license (?:as published by the free software foundation )?version 3 of the license", 6, 0.95),
    ("gpl-2", "version 2 june 1991", "gnu general public license version 2 june 1991", 6, 1.0),
    ("gpl-3", "version 3 29 june 2007", "gnu general public license version 3 29 june 2007", 6, 1.0),
    ("gpl-1", "version 1 february 1989", "gnu general public license version 1 february 1989", 6, 1.0),
    ("lgpl-2", "version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999", 6, 1.0),
    ("lgpl-2", "version 2 june 1991", "gnu library general public license version 2 june 1991", 6, 1.0),
    ("lgpl-3", "version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007", 6, 1.0),
    ("agpl-3", "version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007", 6, 1.0),
    ("lgpl-2", "either version 2", "(?:lesser|library) general public license as published by the free software foundation either version 2(?: 1)? of the license or at your option any later version", 6, 1.0),
    ("lgpl-3", "either version 3", "lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 6, 1.0),
    ("agpl-3", "either version 3", "affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 6, 1.0),
    ("gpl", "general public licen", "(?:gnu )?general public licen[cs]e", 1, 0.6),
    ("lgpl", "general public licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e", 1, 0.6),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", 1, 0.6),
    ("gpl", "gnu org", "(?:www )?gnu org (?:licenses|copyleft) gpl(?: [123] 0)?(?: html| txt)?", 4, 0.8),
    ("lgpl", "gnu org", "(?:www )?gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: [23] [01])?(?: html| txt)?", 4, 0.8),
    ("agpl", "gnu org", "(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 4, 0.8),
    ("fdl-1", "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 6, 1.0),
    ("fdl-1", "free documentation licen", "(?:gnu )?free documentation licen[cs]e", 1, 0.7),
    ("gpl-classpath", "classpath", "(?:gpl 2 0 with|with the) classpath exception", 5, 0.9),
    ("gpl-classpath", "linking this library", "linking this library statically or dynamically with other modules is making a combined work based on this library", 6, 0.95),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", 6, 1.0),
    ("mpl-2", "incompatible with secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", 6, 1.0),
    ("mpl-2", "mozilla org mpl 2", "(?:http |https )?(?:www )?mozilla org mpl 2 0", 6, 1.0),
    ("mpl-1", "mozilla public license version 1", "the contents of this file are (?:subject to|used with permission subject to) the mozilla public license version 1 [01]", 6, 1.0),
    ("mpl-1", "mpl 1 1 gpl 2 0", "mpl 1 1 gpl 2 0 lgpl 2 1", 6, 1.0),
    ("npl-1", "netscape", "netscape public license(?: version)? 1 [01]", 5, 0.9),
    ("epl-1", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1(?: 0)?", 6, 1.0),
    ("epl-2", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?(?:version )?v?2 0", 6, 1.0),
    ("epl-1", "eclipse org legal epl", "(?:www )?eclipse org legal epl v10(?: html)?", 5, 0.95),
    ("epl-2", "eclipse org legal epl", "(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?", 5, 0.95),
    ("edl-1", "eclipse org org documents edl", "(?:www )?eclipse org org documents edl v10(?: php| html)?", 5, 0.95),
    ("cddl-1", "development and distribution", "the contents of this file are subject to the terms of the common development and distribution license", 6, 1.0),
    ("cddl-1", "cddl", "cddl header start", 5, 0.95),
    ("boost-1", "boost software license", "boost software license version 1 0 august 17th 2003", 6, 1.0),
    ("boost-1", "license 1 0", "(?:www )?boost org license 1 0 txt", 6, 1.0),
    ("boost-1", "obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 6, 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 6, 1.0),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 6, 1.0),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 6, 0.9),
    ("libpng", "png reference library", "the png reference library is supplied as is", 6, 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 6, 1.0),
    ("unlicense", "unlicense org", "(?:http |https )?(?:www )?unlicense org", 6, 1.0),
    ("cc0-1", "publicdomain zero", "(?:http |https )?(?:www )?creativecommons org publicdomain zero 1 0(?: legalcode)?", 6, 1.0),
    ("cc0-1", "waived all copyright", "(?:has )?waived all copyright and related or neighboring rights", 6, 0.95),
    ("cc0-1", "cc0 1 0 universal", "cc0 1 0 universal", 6, 1.0),
    ("cc-by", "creativecommons org", "(?:http |https )?(?:www )?creativecommons org licenses by [1-4] [05](?: [a-z]{2})?", 6, 1.0),
    ("cc-by-sa", "creativecommons org", "(?:http |https )?(?:www )?creativecommons org licenses by sa [1-4] [05](?: [a-z]{2})?", 6, 1.0),
    ("cc-by-nd", "creativecommons org", "(?:http |https )?(?:www )?creativecommons org licenses by nd [1-4] [05](?: [a-z]{2})?", 6, 1.0),
    ("cc-by-nc", "creativecommons org", "(?:http |https )?(?:www )?creativecommons org licenses by nc [1-4] [05](?: [a-z]{2})?", 6, 1.0),
    ("cc-by-nc-sa", "creativecommons org", "(?:http |https )?(?:www )?creativecommons org licenses by nc sa [1-4] [05](?: [a-z]{2})?", 6, 1.0),
    ("cc-by-nc-nd", "creativecommons org", "(?:http |https )?(?:www )?creativecommons org licenses by nc nd [1-4] [05](?: [a-z]{2})?", 6, 1.0),
    ("creative-commons", "creative commons licen", "creative commons licen[cs]e", 1, 0.6),
    ("creative-commons", "some rights reserved", "some rights reserved", 1, 0.5),
    ("wtfpl", "you just do what", "you just do what the (?:fuck|f) you want to", 6, 1.0),
    ("wtfpl", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 6, 1.0),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", 6, 1.0),
    ("beerware", "beer", "the beer ?ware license", 5, 0.95),
    ("artistic-2", "artistic license 2 0", "the artistic license 2 0", 5, 0.95),
    ("artistic-1", "intent of this document", "the intent of this document is to state the conditions under which a package may be copied", 6, 0.9),
    ("perl", "same terms as perl", "under the same terms as perl(?: itself)?", 5, 0.9),
    ("python-2", "python software foundation license", "python software foundation license version 2", 6, 1.0),
    ("python-2", "psf license agreement", "psf license agreement for python", 6, 1.0),
    ("php-3", "php license", "this source file is subject to version 3 0[01]? of the php license", 6, 1.0),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 6, 1.0),
    ("hpnd", "without fee is hereby granted", "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose(?: and)? without fee is hereby granted", 5, 0.9),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 6, 1.0),
    ("openssl", "eric young", "this product includes cryptographic software written by eric young", 6, 0.9),
    ("curl", "above copyright notice and this permission notice appear", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies except as contained in this notice", 7, 0.95),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising", 6, 1.0),
    ("ncsa", "following disclaimers", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", 6, 0.9),
    ("ofl-1", "font software", "this font software is licensed under the sil open font license version 1 1", 6, 1.0),
    ("ofl-1", "reserved font name", "with reserved font name", 5, 0.9),
    ("eupl-1", "eupl", "licensed under the eupl(?: version)?(?: v? ?1 [012])?", 6, 1.0),
    ("cecill", "cecill", "this software is governed by the cecill(?: [bc])? license under french law", 6, 1.0),
    ("ms-pl", "microsoft public license", "microsoft public license ms pl this license governs use of the accompanying software", 6, 1.0),
    ("upl-1", "universal permissive", "the universal permissive license upl version 1 0", 6, 1.0),
    ("afl-3", "academic free license", "licensed under the academic free license version 3 0", 6, 1.0),
    ("osl-3", "open software license", "licensed under the open software license version 3 0", 6, 1.0),
    ("busl-1", "change date", "business source license 1 1 (?:[^ ]+ ){0,60}change date", 6, 0.95),
    ("sspl-1", "server side public license", "server side public license version 1 october 16 2018", 6, 1.0),
    ("elastic-2", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service", 6, 1.0),
    ("commons-clause", "commons clause", "commons clause license condition(?: v? ?1 0)?", 6, 1.0),
    ("json", "good not evil", "the software shall be used for good not evil", 6, 1.0),
    ("odbl-1", "opendatacommons", "(?:http |https )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?", 6, 1.0),
    ("odc-by-1", "opendatacommons", "(?:http |https )?(?:www )?opendatacommons org licenses by(?: 1 0)?", 6, 1.0),
    ("pddl-1", "opendatacommons", "(?:http |https )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?", 6, 1.0),
    ("ogl-3", "open government licen", "open government licen[cs]e(?: v| version)?(?: ?3(?: 0)?)?", 5, 0.95),
    ("public-domain", "public domain", "(?:released|placed|dedicated|donated|is|are|put) (?:in|into|to) the public domain", 4, 0.9),
    ("public-domain", "public domain", "public domain (?:software|work|dedication)", 3, 0.7),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code", 6, 1.0),
    ("public-domain", "copyright", "no (?:known )?copyright (?:restrictions|is claimed)", 4, 0.8),
    ("us-government", "government", "work of the (?:united states|u s) government", 4, 0.9),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 4, 0.9),
    ("proprietary", "may not be", "may not be (?:reproduced|copied|distributed|used|disclosed)(?: [^ ]+){0,6} without (?:the )?(?:prior |express |explicit |written ){1,3}(?:permission|consent|authorization)", 4, 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution)(?: [^ ]+){0,8} is (?:strictly )?prohibited", 4, 0.85),
    ("proprietary", "without permission", "(?:may not|must not|shall not) be (?:reproduced|copied|distributed) without permission", 2, 0.7),
    ("proprietary", "rights reserved", "all rights reserved", 0, 0.5),
    ("eula", "end user licen", "end user licen[cs]e agreement", 4, 0.9),
    ("cc-by-sa", "attribution sharealike", "attribution sharealike [1-4] [05](?: international| unported)?", 3, 0.9),
    ("cc-by-nc-sa", "noncommercial sharealike", "attribution noncommercial sharealike [1-4] [05](?: international| unported)?", 3, 0.9),
    ("cc-by-nc-nd", "noncommercial noderivatives", "attribution noncommercial noderivatives [1-4] [05](?: international| unported)?", 3, 0.9),
    ("cc-by-nc", "attribution noncommercial", "attribution noncommercial [1-4] [05](?: international| unported)?", 3, 0.9),
)
#: A text without any of these has no match: tried by substring search on lower(text), which keeps them all.
NEEDLES = (
    "licen", "under", "reserved", "permission", "redistribution", "public", "copyright", "granted", "gpl", "apache", "bsd", "mpl", "epl", "cddl", "unlicense", "wtfpl", "creativecommons", "opendatacommons",
    "artistic", "eupl", "prohibited", "misrepresented", "proprietary", "0bsd", "cc0", "noncommercial", "sharealike", "gnu", "classpath", "mozilla", "boost", "png", "beer", "evil", "software", "postgresql",
    "government", "combined work", "without the", "without prior", "without express", "without explicit", "without written", "do what", "endorse", "copies", "restriction", "to deal in", "as is", "consortium", "secondary", "commons", "eric young", "change date", "third parties", "intent of this", "author", "busl", "bsl", "ofl", "odbl", "psf", "php", "upl", "sspl", "warrant", "eclipse",
)


def _around(context: int, label: str, name: str) -> str:
    """The pattern of a name in a context."""
    if context == 2 and label == "commercial":
        return COMMERCIAL
    return (COMMON_UNDER if context == 0 and label in COMMON else CONTEXTS[context][0]).replace("{}", f"(?:{name})")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence) of every rule, in order. A keyword is a string that each match holds."""
    named = [(label, key, _around(i, label, name), priority, confidence) for i, (_, priority, confidence) in enumerate(CONTEXTS) for label, key, name in NAMES]
    return [*SIGNATURES, *named, *((label, key, name, 3, 0.85) for label, key, name in VERSIONED), *((label, key, name, 2, 0.75) for label, key, name in IDENTIFIERS)]


#: What a text must hold for a rule of that context to be tried at all, in the order of CONTEXTS.
CONTEXT_KEYS = ("under", "licen", "licen")


def tagged_pattern(pattern: str) -> str:
    """The pattern over tagged words (see scan_licenses): before each word stand its position and a colon."""
    return "(?<![^ ])[0-9]+:(?:" + pattern.replace(" ", "(?: [0-9]+:)") + ")(?![^ ])"


def _gate(low: str, text: str) -> Column:
    """Whether a text can have a match of any rule or base phrase, from columns of it in lower case and as it is."""
    held = " or ".join(f"contains({low}, '{n}')" for n in NEEDLES)
    alone = f"(length({text}) <= 16 and {low} rlike '^[^a-z0-9]*(?:{'|'.join(x for _, x in ALONE)})[^a-z0-9]*$')"
    gap = "[^0-9a-z\\\\x80-\\\\x{10FFFF}]+"
    short = f"{low} rlike 'cc{gap}by{gap}(?:n[cd]|sa|[1-4])|ms{gap}[pr]l'"
    return F.expr(f"{held} or {short} or {alone}")


def _places(words: Column, phrase: str) -> Column:
    """Positions of the words at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    at = lambda i, k: F.get(words, i + k) == parts[k]

    def all_of(i: Column) -> Column:
        out = at(i, 0)
        for k in range(1, len(parts)):
            out = out & at(i, k)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), all_of)).otherwise(F.array().cast("array<int>"))


HITS = "array<struct<rule:int,hits:array<string>>>"


def _hits(joined: str, tagged: str) -> Column:
    """What each tried rule matches in the tagged words, as HITS. The expression is written as SQL text: a few hundred
    rules would take thousands of calls to the JVM."""
    every = rules()
    none = f"cast(array() as {HITS})"
    named = range(len(SIGNATURES), len(SIGNATURES) + len(NAMES) * len(CONTEXTS))
    groups: dict[str, dict[str, list[int]]] = {}
    for i, (_, key, *_) in enumerate(every):
        context = CONTEXT_KEYS[(i - named.start) // len(NAMES)] if i in named else ""
        groups.setdefault(context, {}).setdefault(key, []).append(i)

    def tried(own: list[int]) -> str:
        return "array(" + ", ".join(f"named_struct('rule', {i}, 'hits', regexp_extract_all({tagged}, '{tagged_pattern(every[i][2])}', 0))" for i in own) + ")"

    blocks = []
    for context, keys in groups.items():
        block = "flatten(array(" + ", ".join(f"case when contains({joined}, '{key}') then {tried(own)} else {none} end" for key, own in keys.items()) + "))"
        blocks.append(f"case when contains({joined}, '{context}') then {block} else {none} end" if context else block)
    return F.expr(f"filter(flatten(array({', '.join(blocks)})), x -> size(x.hits) > 0)")


DETECTION = "array<struct<start:int,stop:int,priority:int,label:string,confidence:double>>"


def _detections(hits: Column) -> Column:
    """Every match as (start, stop, priority, label, confidence), by start, then the longest, then the highest priority."""
    meta = F.expr("array(" + ", ".join(f"named_struct('priority', {priority}, 'label', '{label}', 'confidence', {confidence}D)" for label, _, _, priority, confidence in rules()) + ")")

    def one(rule: Column, hit: Column) -> Column:
        start = F.substring_index(hit, ":", 1).cast("int")
        words = F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit(""))) + 1
        own = F.get(meta, rule)
        # sorted as they stand: the negative ones first
        return F.struct(start.alias("start"), (-(start + words)).alias("back"), (-own["priority"]).alias("rank"), own["label"].alias("label"), own["confidence"].alias("confidence"))

    return F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(x["hits"], lambda h: one(x["rule"], h)))))


#: Places of a block of the running maximum.
BLOCK = 128


def _before(values: Column) -> Column:
    """For each place of an array the largest value before it, -1 for none: that of the blocks before its own, then of at most
    BLOCK values. values must be bound (let), so that it isn't made anew at each place."""
    top = lambda x: F.coalesce(F.array_max(x), F.lit(-1))
    blocks = F.transform(F.sequence(F.lit(0), (F.size(values) / BLOCK).cast("int")), lambda c: top(F.slice(values, c * BLOCK + 1, F.lit(BLOCK))))
    placed = lambda tops: F.transform(values, lambda _, i: F.greatest(F.get(tops, (i / BLOCK).cast("int")), top(F.slice(values, i - F.pmod(i, F.lit(BLOCK)) + 1, F.pmod(i, F.lit(BLOCK))))))
    return let(blocks, lambda b: let(F.transform(b, lambda _, c: top(F.slice(b, F.lit(1), c))), placed))


def _stand(found: Column) -> Column:
    """The sorted matches without suppressed ones. What can hold a match stands before it, so the largest stop
    up to it, of a higher priority or before its own interval's first match of the same, tells. These running maxima are made
    once a level, so a text's matches cost time in proportion but for one step in BLOCK squared."""
    levels = sorted({r[3] for r in rules()})

    def stand(own: Column) -> Column:
        key = F.transform(own, lambda x: x["start"].cast("long") * F.lit(1 << 32) - x["back"])
        new = lambda k: F.transform(k, lambda x, i: F.when((i > 0) & (F.get(k, i - 1) == x), F.lit(0)).otherwise(i))
        # where the first match of the same interval stands
        first = let(let(key, new), lambda f: F.zip_with(_before(f), f, lambda a, b: F.greatest(a, b)))
        stops = lambda p: F.transform(own, lambda x: F.when(x["rank"] == -p, -x["back"]).otherwise(-1))
        runs = F.struct(first.alias("first"), *(let(stops(p), _before).alias(f"p{k}") for k, p in enumerate(levels)))

        def kept(made: Column) -> Column:
            def keep(x: Column, i: Column) -> Column:
                held = F.lit(False)
                for k, p in enumerate(levels):
                    before = F.when(x["rank"] == -p, F.get(made["first"], i)).otherwise(i)
                    held = held | ((x["rank"] >= -p) & (F.get(made[f"p{k}"], before) >= -x["back"]))
                return ~held

            return F.filter(own, keep)

        return let(runs, kept)

    def strong(kept: Column) -> Column:
        return let(F.exists(kept, lambda x: x["rank"] < 0), lambda some: F.filter(kept, lambda x: (x["rank"] < 0) | ~some))

    kept = let(let(found, stand), strong)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), (-x["rank"]).alias("priority"), x["label"].alias("label"), x["confidence"].alias("confidence")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (start, label of every base place), and detections (start, stop in words,
    priority, label, confidence) that stand after suppression, of every row.

    A null or empty text has no words. Repeated rows and null ids are kept, extra columns ignored; an
    empty table gives no row. Equal intervals of equal priority all stand. A text's words are an array of the row: long
    texts cost time in proportion and some 50 bytes a word."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(WORDS)).cast("long"))
    rows = rows.withColumn("low", F.lower("text")).withColumn("gate", _gate("low", "text")).drop("low")
    # without lower(): that would also change other letters; only gated texts are rewritten
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = rows.withColumn("joined", F.when(F.col("gate"), F.trim(F.regexp_replace(F.translate("text", upper, lower), GAP, " ")))).drop("text", "gate")
    rows = rows.withColumn("words", F.when(F.col("joined") != "", F.split("joined", " ")))

    def placed(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("words"), phrase), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<start:bigint,label:string>>")
    base = F.concat(*[F.when(F.col("joined").contains(phrase), placed(phrase, label)).otherwise(none) for phrase, label in BASE])
    rows = rows.withColumn("base", F.when(F.col("words").isNotNull(), base).otherwise(none))
    # words with their positions, so that a match tells where it stands
    tagged = F.array_join(F.transform("words", lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " ")
    rows = rows.withColumn("tagged", F.when(F.col("words").isNotNull(), tagged))
    rows = rows.withColumn("hits", F.when(F.col("words").isNotNull(), _hits("joined", "tagged")))
    cases = " ".join(f"when '{name}' then array(named_struct('start', 0, 'stop', 1, 'priority', 2, 'label', '{label}', 'confidence', 0.75D))" for label, name in ALONE)
    alone = F.expr(f"case joined {cases} end")
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, _detections(F.col("hits"))))
    stands = F.when(F.size("found") > 0, _stand(F.col("found"))).when(F.length("joined") <= 16, alone)
    return rows.select("doc_id", "n_words", "base", F.coalesce(stands.cast(DETECTION), F.array().cast(DETECTION)).alias("detections"))


def op9_license_signature_rules(spark, sf_dir: str) -> DataFrame:
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"])
    found = F.transform("detections", lambda x: x["label"])
    best = F.array_max(F.concat(F.transform("detections", lambda x: x["confidence"]), F.transform("base", lambda x: F.lit(0.9)), F.array(F.lit(0.0))))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(own).alias("base_labels"), listed(F.concat(own, found)).alias("labels"), best.alias("score"),
    )
