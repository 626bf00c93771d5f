"""Licence signature rules: families of names written by hand, and the phrasings around them that make the full rules.

Rules are matched on normalised text: lower-case words with one space between them. A rule's gate is a word that every
match of it holds. A lower priority number wins.
"""

from __future__ import annotations

# Label, gate word, name pattern
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?(?: public)? licen[sc]e"),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[sc]e"),
    ("bsd", "bsd", r"(?:(?:2|3|4|two|three|four) clause )?bsd(?: style)?(?: (?:2|3|4) clause)? licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl", "gplv2", r"gplv2"),
    ("gpl", "gplv3", r"gplv3"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl", "mpl", r"mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cpl", "common", r"common public licen[sc]e"),
    ("cddl", "common", r"common development and distribution licen[sc]e"),
    ("cddl", "cddl", r"cddl"),
    ("eupl", "european", r"european union public licen[sc]e"),
    ("eupl", "eupl", r"eupl"),
    ("osl", "open", r"open software licen[sc]e"),
    ("afl", "academic", r"academic free licen[sc]e"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e"),
    ("boost", "boost", r"boost software licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python", "python", r"python software foundation licen[sc]e"),
    ("php", "php", r"php licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e"),
    ("odbl", "odbl", r"odbl"),
    ("odbl", "database", r"open(?: data commons open)? database licen[sc]e"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e"),
    ("pddl", "pddl", r"pddl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("upl", "universal", r"universal permissive licen[sc]e"),
    ("ipl", "ibm", r"ibm public licen[sc]e"),
    ("apsl", "apple", r"apple public source licen[sc]e"),
    ("ecl", "educational", r"educational community licen[sc]e"),
    ("qpl", "q", r"q public licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("zpl", "zope", r"zope public licen[sc]e"),
    ("cecill", "cecill", r"cecill"),
    ("mulan", "mulan", r"mulan(?: permissive software| psl)? licen[sc]e"),
    ("sspl", "server", r"server side public licen[sc]e"),
    ("busl", "business", r"business source licen[sc]e"),
    ("elastic", "elastic", r"elastic licen[sc]e"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m| d)?"),
    ("cc0", "cc0", r"cc0"),
    ("cc-by-nc-nd", "nd", r"(?:cc|creative commons) by nc nd"),
    ("cc-by-nc-sa", "sa", r"(?:cc|creative commons) by nc sa"),
    ("cc-by-nc", "nc", r"(?:cc|creative commons) by nc"),
    ("cc-by-nd", "nd", r"(?:cc|creative commons) by nd"),
    ("cc-by-sa", "sa", r"(?:cc|creative commons) by sa"),
    ("cc-by", "cc", r"cc by"),
    ("cc", "creative", r"creative commons(?: attribution)?(?: non ?commercial)?(?: share ?alike| no ?derivatives)?(?: \d)?(?: \d)?(?: international| unported)?"),
]

# Phrasing name, priority, weight, text before and after the name
PHRASINGS = [
    ("grant", 1, 1.0, r"(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?", r"(?: v(?:ersion)?)?(?: v?\d{1,2})?(?: \d)?(?: or (?:any )?later(?: version)?)?"),
    ("version", 2, 0.9, r"", r" (?:v(?:ersion)? ?)?v?\d{1,2}(?: \d)?(?: or (?:any )?later(?: version)?)?"),
    ("identifier", 1, 1.0, r"(?:spdx )?licen[sc]e(?: identifier| name| id)? ", r"(?: \d)?(?: \d)?(?: only| or later)?"),
    ("see", 3, 0.7, r"(?:see|read|refer to|subject to|governed by|covered by) (?:the )?", r"(?: for (?:more )?details)?"),
    ("name", 4, 0.5, r"", r""),
]

# Label, gate word, pattern, priority, weight
SINGLE = [
    ("copyright", "copyright", r"copyright(?: c)?(?: by)? (?:19|20)\d\d(?: (?:19|20)\d\d)*", 3, 0.6),
    ("copyright", "copyrighted", r"copyrighted (?:by|material|work)", 3, 0.5),
    ("reserved", "reserved", r"all rights are reserved", 3, 0.6),
    ("reserved", "reserved", r"(?:some|no) rights reserved", 3, 0.5),
    ("reserved", "droits", r"tous droits réservés", 3, 0.6),
    ("reserved", "rechte", r"alle rechte vorbehalten", 3, 0.6),
    ("reserved", "derechos", r"todos los derechos reservados", 3, 0.6),
    ("public-domain", "domain", r"(?:released|placed|dedicated)(?: in| into| to)? the public domain", 2, 0.9),
    ("public-domain", "domain", r"public domain(?: dedication| mark)?", 4, 0.5),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0, 1.0),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose", 0, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 0, 1.0),
    ("gpl", "redistribute", r"free software you can redistribute it and or modify it", 0, 0.9),
    ("warranty", "warranty", r"without (?:any )?warranty(?: of any kind)?", 4, 0.3),
    ("warranty", "warranties", r"without (?:any )?warranties(?: of any kind)?", 4, 0.3),
    ("zlib", "warranty", r"as is without any express or implied warranty", 0, 0.8),
    ("apache", "compliance", r"may not use this file except in compliance with the licen[sc]e", 0, 1.0),
    ("apache", "apache", r"www apache org licen[sc]es(?: licen[sc]e)? 2 0", 0, 1.0),
    ("gpl", "gnu", r"www gnu org licen[sc]es(?: gpl)?(?: \d)?(?: \d)?", 0, 0.9),
    ("mit", "opensource", r"opensource org licen[sc]es mit", 0, 1.0),
    ("bsd", "opensource", r"opensource org licen[sc]es bsd(?: \d clause)?", 0, 1.0),
    ("mpl", "mozilla", r"mozilla org mpl(?: 2 0)?", 0, 1.0),
    ("cc", "creativecommons", r"creativecommons org (?:licen[sc]es|publicdomain)(?: by| zero)?(?: nc)?(?: nd| sa)?(?: \d)?(?: \d)?", 0, 0.9),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e", 0, 1.0),
    ("proprietary", "proprietary", r"proprietary and confidential", 2, 0.8),
    ("proprietary", "reproduced", r"may not be reproduced(?: or (?:reproduced|copied|redistributed))*", 3, 0.5),
    ("proprietary", "copied", r"may not be copied(?: or (?:reproduced|copied|redistributed))*", 3, 0.5),
    ("proprietary", "redistributed", r"may not be redistributed(?: or (?:reproduced|copied|redistributed))*", 3, 0.5),
    ("non-commercial", "commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?", 4, 0.4),
    ("research-only", "research", r"(?:for )?research (?:use|purposes) only", 4, 0.4),
]

# The base phrases and their labels
BASE = [("cc-by", "cc", r"cc by"), ("gpl", "general", r"general public license"), ("reserved", "reserved", r"all rights reserved")]

#: Stems of which every rule's match holds at least one; documents without any are not scanned further.
GATE = (r"(?i)licen|copyright|reserv|réserv|rechte[^a-z0-9]+vorb|public|cc0|cc[^a-z0-9]+by|commons|openrail|gpl|gfdl|mpl|cddl|eupl|wtfpl|odbl|pddl|cecill|warrant"
        r"|hereby|redistribut|free[^a-z0-9]+software|any[^a-z0-9]+purpose|mozilla|proprietary|reproduced|copied|commercial|research")


def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(label, gate, pattern, priority, weight, is_base), whole words only."""
    out = [(label, gate, p, 4, 0.5, True) for label, gate, p in BASE]
    out += [(label, gate, before + name + after, priority, weight, False) for label, gate, name in FAMILIES for _, priority, weight, before, after in PHRASINGS]
    out += [(*x, False) for x in SINGLE]
    return [(label, gate, f"(?<= )(?:{p})(?= )", priority, weight, base) for label, gate, p, priority, weight, base in out]
