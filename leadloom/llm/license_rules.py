"""Signature rules of the license scan, over texts reduced to lower-case words with one space between.

A rule is (label, priority, needed words, pattern). Its pattern starts and ends at words; `needed` are words without which it
cannot match. Priorities: 1 a hint, 2 a name, 3 a name with its version, 4 a notice, an address or an exact grant.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    needs: tuple[str, ...]
    pattern: str


# The phrases whose places are always counted.
BASE = (
    Rule("gpl", 2, ("gnu", "general"), "gnu general public license"),
    Rule("apache", 2, ("apache", "license"), "apache license"),
    Rule("cc-by", 2, ("cc", "by"), "cc by"),
    Rule("mit", 2, ("mit", "license"), "mit license"),
)

# label; priority; needed words; pattern
WRITTEN = """
mit; 4; permission hereby copy; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; 4; mit spdx; spdx license identifier mit
mit; 4; mit opensource; opensource org licenses? mit(?: license)?(?: php| html)?
mit; 3; mit licensed; licensed under (?:the )?(?:terms of the )?mit(?: license)?
mit; 3; mit released; released under (?:the )?(?:terms of the )?mit(?: license)?
mit; 2; expat; expat (?:mit )?license|mit expat
mit-0; 3; mit; mit 0|mit no attribution
mit-0; 4; permission hereby copy; permission is hereby granted(?: [^ ]+){5,90}? to permit persons to whom the software is furnished to do so the software is provided as is
x11; 2; x11; x11 license|mit x11(?: license)?
mit-cmu; 2; cmu; cmu license|mit cmu
apache-2.0; 4; apache license; apache license version 2(?: 0)?(?: january 2004)?
apache-2.0; 3; apache license; apache license v? ?2(?: 0)?
apache-2.0; 3; apache; apache (?:2 0|v2|2)(?: license)?
apache-2.0; 3; apache software; apache software license (?:version |v )?2(?: 0)?
apache-2.0; 4; apache licenses; apache org licenses license 2 0(?: txt| html)?
apache-2.0; 4; apache spdx; spdx license identifier apache 2 0
apache-2.0; 3; asl; asl 2(?: 0)?
apache-2.0; 4; apache licensed; licensed under the apache license version 2 0(?: the license)?
apache-1.1; 3; apache; apache (?:software )?(?:license )?(?:version )?1 1
apache-1.1; 4; apache spdx; spdx license identifier apache 1 1
apache-1.0; 3; apache; apache (?:software )?(?:license )?(?:version )?1 0
apache; 2; apache software; apache software license
bsd; 4; redistribution binary; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; 4; redistribution binary; redistributions of source code must retain(?: [^ ]+){10,40}? redistributions in binary form must reproduce(?: [^ ]+){10,40}? provided with the distribution
bsd-3-clause; 4; redistribution neither endorse; redistributions in binary form must reproduce(?: [^ ]+){10,60}? neither the name of(?: [^ ]+){3,40}? endorse or promote products
bsd-4-clause; 4; advertising acknowledgement; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause; 3; bsd; bsd 2 clause(?: simplified)?(?: license)?|2 clause bsd(?: license)?|two clause bsd(?: license)?|simplified bsd license
bsd-3-clause; 3; bsd; bsd 3 clause(?: new| revised)?(?: license)?|3 clause bsd(?: license)?|three clause bsd(?: license)?|(?:new|modified|revised) bsd license
bsd-4-clause; 3; bsd; bsd 4 clause(?: original)?(?: license)?|4 clause bsd(?: license)?|(?:original|old) bsd license
0bsd; 3; 0bsd; 0bsd(?: license)?
0bsd; 3; bsd clause; bsd zero clause(?: license)?|bsd 0 clause(?: license)?|zero clause bsd(?: license)?
bsd-1-clause; 3; bsd clause; bsd 1 clause
bsd-3-clause-clear; 3; bsd clear; bsd 3 clause clear|clear bsd license
bsd; 2; bsd license; bsd(?: style| type)? license
bsd; 3; bsd licensed; licensed under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: license)?
bsd; 4; bsd opensource; opensource org licenses? bsd(?: license)?(?: php)?
isc; 3; isc; isc license|isc licence
isc; 4; isc spdx; spdx license identifier isc
isc; 4; permission fee hereby; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd; 3; historical permission; historical permission notice and disclaimer
mpl-1.0; 3; mozilla; mozilla public license (?:version |v )?1 0
mpl-1.1; 3; mozilla; mozilla public license (?:version |v )?1 1
mpl-2.0; 3; mozilla; mozilla public license (?:version |v )?2(?: 0)?
mpl-2.0; 4; mozilla mpl; mozilla org mpl 2 0|mozilla org en us mpl 2 0
mpl-2.0; 4; mozilla subject; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1; 3; mpl; mpl 1 1
mpl-2.0; 3; mpl; mpl 2 0
mpl; 2; mozilla; mozilla public license
epl-1.0; 3; eclipse; eclipse public license (?:version |v )?1(?: 0)?
epl-2.0; 3; eclipse; eclipse public license (?:version |v )?2(?: 0)?
epl-1.0; 3; epl; epl (?:v )?1 0
epl-2.0; 3; epl; epl (?:v )?2 0
epl-1.0; 4; eclipse epl; eclipse org legal epl v10(?: html)?
epl-2.0; 4; eclipse epl; eclipse org legal epl (?:2 0|v20)(?: html)?
epl; 2; eclipse; eclipse public license
edl-1.0; 3; eclipse distribution; eclipse distribution license(?: v| version)?(?: 1 0)?
eupl-1.1; 3; eupl; eupl (?:v )?1 1
eupl-1.2; 3; eupl; eupl (?:v )?1 2
eupl-1.2; 3; european union; european union public licen[cs]e (?:version |v )?1 2
eupl-1.1; 3; european union; european union public licen[cs]e (?:version |v )?1 1
eupl; 2; european union; european union public licen[cs]e
cddl-1.0; 3; cddl; cddl (?:v )?1 0
cddl-1.1; 3; cddl; cddl (?:v )?1 1
cddl-1.0; 3; common distribution; common development and distribution license (?:version |v )?1 0
cddl; 2; common distribution; common development and distribution license
cpl-1.0; 3; common public; common public license(?: version| v)?(?: 1 0)?
cpal-1.0; 3; common attribution; common public attribution license(?: version| v)?(?: 1 0)?
ipl-1.0; 3; ibm; ibm public license(?: version| v)?(?: 1 0)?
artistic-1.0; 3; artistic; artistic license (?:version |v )?1(?: 0)?
artistic-2.0; 3; artistic; artistic license (?:version |v )?2(?: 0)?
artistic; 2; artistic; artistic license
perl; 3; perl terms; same terms as perl(?: 5)?(?: itself)?
zlib; 3; zlib; zlib license|zlib libpng license|zlib libpng
zlib; 4; altered misrepresented; the origin of this software must not be misrepresented
libpng; 3; libpng; libpng license
libpng; 3; png reference; png reference library license
bsl-1.0; 3; boost; boost software license(?: version| v)?(?: 1 0)?
bsl-1.0; 4; boost license; boost org license 1 0(?: txt)?
unlicense; 3; unlicense; (?:the )?unlicense(?: license)?
unlicense; 4; free unencumbered; this is free and unencumbered software released into the public domain
wtfpl; 3; wtfpl; wtfpl(?: version 2| v2)?
wtfpl; 4; fuck public; do what the fuck you want to public license
cc0-1.0; 3; cc0; cc0(?: 1 0)?(?: universal)?
cc0-1.0; 3; creative zero; creative commons zero(?: v1 0)?(?: universal)?
cc0-1.0; 4; creativecommons publicdomain; creativecommons org publicdomain zero 1 0
cc-pdm-1.0; 4; creativecommons publicdomain; creativecommons org publicdomain mark 1 0
creative-commons; 2; creative commons; creative commons licen[cs]e
creative-commons; 1; creative commons; creative commons
public-domain; 3; public domain; (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain; 1; public domain; public domain
ofl-1.1; 3; sil font; sil open font license(?: version| v)?(?: 1 1)?
ofl-1.1; 3; ofl; ofl 1 1
ofl-1.1; 4; ofl sil; scripts sil org ofl
odbl-1.0; 3; odbl; odbl(?: 1 0)?
odbl-1.0; 3; open database; open database license(?: odbl)?(?: v1 0| 1 0)?
odc-by-1.0; 3; odc; odc by(?: 1 0)?
odc-by-1.0; 3; open commons attribution; open data commons attribution license(?: v1 0| 1 0)?
pddl-1.0; 3; pddl; pddl(?: 1 0)?
pddl-1.0; 3; public dedication; public domain dedication and licen[cs]e
odc; 4; opendatacommons; opendatacommons org licenses (?:odbl|by|pddl)(?: 1 0)?
psf-2.0; 3; python foundation; python software foundation license(?: version 2| 2)?
psf-2.0; 3; psf; psf (?:license|2 0|v2)
cnri-python; 3; cnri; cnri (?:open source )?(?:license agreement|python license)
ruby; 3; ruby; ruby license|ruby s license
php-3.01; 3; php; php license(?: version| v)? 3 01
php; 2; php license; php license
openssl; 3; openssl; openssl license
openssl; 4; openssl toolkit; this product includes software developed by the openssl project
ssleay; 3; ssleay; original ssleay license|ssleay license
curl; 3; curl; curl license
postgresql; 3; postgresql; postgresql licen[cs]e
ncsa; 3; ncsa; university of illinois ncsa open source license|ncsa open source license
w3c; 3; w3c; w3c software (?:notice and )?license|w3c license
w3c; 3; w3c; w3c document license
afl-3.0; 3; academic; academic free license(?: version| v)?(?: 3 0)?
osl-3.0; 3; open software; open software license(?: version| v)? 3 0
ms-pl; 3; microsoft; microsoft public license(?: ms pl)?
ms-rl; 3; microsoft reciprocal; microsoft reciprocal license(?: ms rl)?
ms-pl; 3; ms pl; ms pl
ms-rl; 3; ms rl; ms rl
apsl-2.0; 3; apple; apple public source license(?: version| v)?(?: 2 0)?
cecill-2.1; 3; cecill; cecill (?:version |v )?2 1
cecill-b; 3; cecill; cecill b
cecill-c; 3; cecill; cecill c
cecill; 2; cecill; cecill(?: free software)?(?: license| licence)?
qpl-1.0; 3; qpl; qpl 1 0|q public license(?: version)?(?: 1 0)?
sleepycat; 3; sleepycat; sleepycat license
vim; 3; vim; vim license
json; 4; good evil; the software shall be used for good not evil
json; 3; json license; (?:the )?json license
beerware; 3; beerware; beerware(?: license)?
beerware; 3; beer ware; beer ware license
busl-1.1; 3; business source; business source license(?: version)?(?: 1 1)?
busl-1.1; 3; busl; busl 1 1
sspl-1.0; 3; sspl; sspl(?: 1 0| v1)?
sspl-1.0; 3; server side; server side public license(?: version| v)?(?: 1)?
elastic-2.0; 3; elastic; elastic license(?: version| v)?(?: 2 0)?
commons-clause; 3; commons clause; commons clause(?: license condition)?(?: v1 0| version 1 0)?
polyform-noncommercial-1.0.0; 3; polyform; polyform noncommercial license(?: 1 0 0)?
polyform; 2; polyform; polyform [^ ]+ license
upl-1.0; 3; universal permissive; universal permissive license(?: v| version)?(?: 1 0)?
blueoak-1.0.0; 3; blue oak; blue oak model license(?: 1 0 0)?
ecl-2.0; 3; educational community; educational community license(?: version| v)?(?: 2 0)?
lppl-1.3c; 3; latex; latex project public license(?: version| v)? 1 3c?
lppl; 2; latex; latex project public license
lppl; 2; lppl; lppl
zpl-2.1; 3; zope; zope public license(?: zpl)?(?: version| v)?(?: 2 1)?
tcl; 3; tcl; tcl(?: tk)? license
ijg; 3; jpeg independent; independent jpeg group(?: s)? license
ijg; 4; jpeg independent; this software is based in part on the work of the independent jpeg group
icu; 3; icu; icu license
unicode; 3; unicode; unicode license(?: v3)?|unicode inc license agreement
nasa-1.3; 3; nasa; nasa open source agreement(?: version)?(?: 1 3)?
rpl-1.5; 3; reciprocal; reciprocal public license(?: version)?(?: 1 5)?
spl-1.0; 3; sun; sun public license(?: version| v)?(?: 1 0)?
npl-1.1; 3; netscape; netscape public license(?: version| v)?(?: 1 [01])?
intel; 3; intel; intel open source license
ntp; 3; ntp; ntp license
mulan-psl-2.0; 3; mulan; mulan permissive software license(?: version| v)?2?
bigscience-rail-1.0; 3; bigscience; bigscience (?:bloom )?rail(?: license)?(?: v?1 0)?
openrail; 2; openrail; (?:creativeml )?openrail(?: m)?(?: license)?
llama; 3; llama; llama (?:2 |3 |3 1 )?community license(?: agreement)?
fal-1.3; 3; free art; free art license(?: 1 3)?
dco; 3; developer certificate; developer certificate of origin(?: version)?(?: 1 1)?
ogl-uk-3.0; 3; government; open government licen[cs]e (?:version |v )?3(?: 0)?
ogl-uk; 2; government; open government licen[cs]e
cdla-permissive-2.0; 3; cdla; cdla permissive (?:version )?2 0
cdla-sharing-1.0; 3; cdla; cdla sharing (?:version )?1 0
etalab-2.0; 3; etalab; (?:etalab )?licence ouverte(?: open licence)?(?: etalab)?(?: version)? 2 0
proprietary; 3; proprietary; proprietary and confidential|confidential and proprietary|proprietary license
proprietary; 4; unauthorized copying; unauthorized copying of this file via any medium is strictly prohibited
commercial; 2; commercial license; commercial license(?: agreement)?
eula; 2; end user license; end user license agreement
eula; 1; eula; eula
all-rights-reserved; 2; rights reserved; all rights reserved
all-rights-reserved; 2; rechte vorbehalten; alle rechte vorbehalten
all-rights-reserved; 2; droits; tous droits réservés
all-rights-reserved; 2; derechos reservados; todos los derechos reservados
copyright; 1; copyright; copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
see-license; 1; see license; see (?:the )?license(?: file| txt| md)? for (?:more )?(?:details|information)
spdx; 1; spdx; spdx license identifier
"""

_CC_WORDS = {"nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC_VARIANTS = ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_CC_KIND = "(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"

# code, words of the name, needed words, versions, other spellings
_GNU = (
    ("gpl", "(?:gnu )?general public licen[cs]e", ("general", "public"), ("1", "2", "3")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", ("general", "public"), ("2", "2.1", "3")),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", ("affero",), ("1", "3")),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e", ("documentation",), ("1.1", "1.2", "1.3")),
)


def _creative_commons():
    for variant in _CC_VARIANTS:
        code, short = "-".join(("cc-by", *variant)), " ".join(("cc by", *variant))
        name = " ".join(("attribution", *(_CC_WORDS[v] for v in variant)))
        yield Rule(code, 2, ("cc", "by"), short)
        yield Rule(code, 2, ("creative", "commons", "attribution"), f"creative commons {name}{_CC_KIND}")
        for version in _CC_VERSIONS:
            spaced = version.replace(".", " ")
            yield Rule(f"{code}-{version}", 3, ("cc", "by"), f"{short} {spaced}")
            yield Rule(f"{code}-{version}", 4, ("creativecommons", "licenses"), f"creativecommons org licenses {short[3:]} {spaced}")
            yield Rule(f"{code}-{version}", 4, ("attribution",), f"(?:creative commons )?{name}(?: version)? {spaced}{_CC_KIND}")


def _gnu():
    later = "(?: or)?(?: at your option)?(?: any)? later(?: versions?)?"
    for code, name, needs, versions in _GNU:
        yield Rule(code, 2, needs, name)
        yield Rule(code, 1, (code,), code)
        yield Rule(code, 2, (code, "license"), f"{code} license")
        for version in versions:
            spaced = version.replace(".", " ") + ("" if "." in version else "(?: 0)?")
            full = version if "." in version else f"{version}.0"
            long = f"{name}(?: [a-z]{{3,5}})?(?: as published by the free software foundation)?(?: either)?(?: version| v)? {spaced}"
            yield Rule(f"{code}-{full}", 3, needs, long)
            yield Rule(f"{code}-{full}-or-later", 4, (*needs, "later"), f"{long}(?: of the licen[cs]e)?{later}")
            yield Rule(f"{code}-{full}-only", 4, (*needs, "only"), f"{long}(?: of the licen[cs]e)? only")
            yield Rule(f"{code}-{full}", 3, (code,), f"{code} (?:v |version )?{spaced}")
            yield Rule(f"{code}-{full}-or-later", 4, (code, "later"), f"{code} (?:v |version )?{spaced}{later}")
            yield Rule(f"{code}-{full}-only", 4, (code, "only"), f"{code} (?:v |version )?{spaced} only")
            joined = f"{code}v{version.replace('.', ' ')}"
            yield Rule(f"{code}-{full}", 3, (joined.split(" ")[0],), joined)
            yield Rule(f"{code}-{full}-or-later", 4, (joined.split(" ")[0], "later"), f"{joined}{later}")
            yield Rule(f"{code}-{full}", 4, ("gnu", "licenses", code), f"gnu org licenses (?:old licenses )?{code} {spaced}(?: html| txt| en html)?")


def _written():
    for line in WRITTEN.strip().splitlines():
        label, priority, needs, pattern = (part.strip() for part in line.split(";", 3))
        yield Rule(label, int(priority), tuple(needs.split()), pattern)


def more_rules() -> tuple[Rule, ...]:
    """The written rules, then the families, whose rules differ by variant and version."""
    return (*_written(), *_creative_commons(), *_gnu())
