"""Signature rules of licenses, written over lower-case words parted by one space.

One rule a line: label, then the signature. A signature starts with a plain
word, its keyword, and holds no unbounded repetition, so it ends within
``WINDOW`` words of the keyword. The sections give priority and weight.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Words that a signature may span.
WINDOW = 24


class Rule(NamedTuple):
    number: int
    keyword: str
    pattern: str
    label: str
    priority: int
    weight: float


_SECTIONS = [
    # sentences of the license texts themselves
    (5, 1.0, """
mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit permission is hereby granted free of charge to any person obtaining a copy
isc permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
ntp permission to use copy modify and distribute this software and its documentation for any purpose
bsl-1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
ofl-1.1 permission is hereby granted free of charge to any person obtaining a copy of the font software
bsd redistribution and use in source and binary forms with or without modification are permitted
bsd redistributions of source code must retain the above copyright notice this list of conditions
bsd redistributions in binary form must reproduce the above copyright notice
bsd-3-clause endorse or promote products derived from this software without specific prior written permission
bsd-3-clause contributors may be used to endorse or promote products
bsd-4-clause advertising materials mentioning features or use of this software must display
zlib provided as is without any express or implied warranty in no event will the authors be held liable
zlib altered source versions must be plainly marked as such
wtfpl just do what the (?:fuck|f) you want to
unlicense unencumbered software released into the public domain
gpl redistribute it and or modify it under the terms of the gnu general public license
lgpl redistribute it and or modify it under the terms of the gnu (?:lesser|library)
gpl distributed in the hope that it will be useful
agpl remote network interaction use with the gnu general public license
apache-2.0 licensed under the apache license version 2 0 the license you may not use this file except
apache-2.0 obtain a copy of the license at http www apache org licenses license 2 0
apache-1.1 documentation included with the redistribution if any must include
apache-1.0 products derived from this software may not be called apache
mpl-2.0 source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1 subject to the mozilla public license version 1 1
cddl subject to the terms of the common development and distribution license
epl accompanying materials are made available under the terms of the eclipse public license
artistic everyone is permitted to copy and distribute verbatim copies of this license document
cc0-1.0 associated a work with this deed has dedicated the work to the public domain
cc-by share copy and redistribute the material
proprietary rights reserved(?: \\S+){0,4} unauthorized copying
proprietary unauthorized copying of this (?:file|software) via any medium is strictly prohibited
proprietary confidential and proprietary information of
"""),
    # identifiers after the machine-readable tag
    (4, 1.0, """
mit spdx license identifier mit
mit-0 spdx license identifier mit 0
apache-2.0 spdx license identifier apache 2 0
apache-1.1 spdx license identifier apache 1 1
apache-1.0 spdx license identifier apache 1 0
bsd-1-clause spdx license identifier bsd 1 clause
bsd-2-clause spdx license identifier bsd 2 clause
bsd-2-clause-patent spdx license identifier bsd 2 clause patent
bsd-3-clause spdx license identifier bsd 3 clause
bsd-3-clause-clear spdx license identifier bsd 3 clause clear
bsd-4-clause spdx license identifier bsd 4 clause
0bsd spdx license identifier 0bsd
gpl-1 spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 spdx license identifier lgpl 3 0(?: only| or later)?
agpl-1 spdx license identifier agpl 1 0(?: only| or later)?
agpl-3 spdx license identifier agpl 3 0(?: only| or later)?
gfdl spdx license identifier gfdl 1 [123](?: only| or later)?
mpl-1.0 spdx license identifier mpl 1 0
mpl-1.1 spdx license identifier mpl 1 1
mpl-2.0 spdx license identifier mpl 2 0
epl-1.0 spdx license identifier epl 1 0
epl-2.0 spdx license identifier epl 2 0
eupl-1.1 spdx license identifier eupl 1 1
eupl-1.2 spdx license identifier eupl 1 2
cddl-1.0 spdx license identifier cddl 1 0
cddl-1.1 spdx license identifier cddl 1 1
cpl-1.0 spdx license identifier cpl 1 0
isc spdx license identifier isc
zlib spdx license identifier zlib
bsl-1.0 spdx license identifier bsl 1 0
busl-1.1 spdx license identifier busl 1 1
sspl-1.0 spdx license identifier sspl 1 0
elastic-2.0 spdx license identifier elastic 2 0
unlicense spdx license identifier unlicense
wtfpl spdx license identifier wtfpl
cc0-1.0 spdx license identifier cc0 1 0
cc-by spdx license identifier cc by [1234] [05]
cc-by-sa spdx license identifier cc by sa [1234] [05]
cc-by-nc spdx license identifier cc by nc [1234] [05]
cc-by-nd spdx license identifier cc by nd [1234] [05]
cc-by-nc-sa spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd spdx license identifier cc by nc nd [1234] [05]
artistic-1.0 spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 spdx license identifier artistic 2 0
afl-3.0 spdx license identifier afl 3 0
osl-3.0 spdx license identifier osl 3 0
ofl-1.1 spdx license identifier ofl 1 1
odbl-1.0 spdx license identifier odbl 1 0
odc-by-1.0 spdx license identifier odc by 1 0
pddl-1.0 spdx license identifier pddl 1 0
psf-2.0 spdx license identifier (?:psf|python) 2 0
postgresql spdx license identifier postgresql
ncsa spdx license identifier ncsa
ms-pl spdx license identifier ms pl
ms-rl spdx license identifier ms rl
openssl spdx license identifier openssl
ruby spdx license identifier ruby
vim spdx license identifier vim
x11 spdx license identifier x11
curl spdx license identifier curl
php-3.01 spdx license identifier php 3 01
w3c spdx license identifier w3c
ecl-2.0 spdx license identifier ecl 2 0
upl-1.0 spdx license identifier upl 1 0
mulan-psl-2.0 spdx license identifier mulanpsl 2 0
hpnd spdx license identifier hpnd
zpl-2.1 spdx license identifier zpl 2 1
blueoak-1.0.0 spdx license identifier blueoak 1 0 0
beerware spdx license identifier beerware
"""),
    # titles with a version, and addresses
    (3, 0.9, """
gpl-1 gnu general public license(?: gpl)? v(?:ersion)? ?1(?: 0)?
gpl-2 gnu general public license(?: gpl)? v(?:ersion)? ?2(?: 0)?(?: only| or later)?
gpl-3 gnu general public license(?: gpl)? v(?:ersion)? ?3(?: 0)?(?: only| or later)?
gpl-2 gnu general public license as published by the free software foundation either version 2
gpl-3 gnu general public license as published by the free software foundation either version 3
gpl-2 gnu gpl ?v(?:ersion)? ?2
gpl-3 gnu gpl ?v(?:ersion)? ?3
gpl-2 gplv2
gpl-3 gplv3
gpl-2 gpl 2 0
gpl-3 gpl 3 0
gpl-2 gpl v(?:ersion)? ?2
gpl-3 gpl v(?:ersion)? ?3
lgpl-2 gnu library general public license v(?:ersion)? ?2(?: 0)?
lgpl-2.1 gnu lesser general public license(?: lgpl)? v(?:ersion)? ?2 1
lgpl-3 gnu lesser general public license(?: lgpl)? v(?:ersion)? ?3(?: 0)?
lgpl-2.1 lgplv2 1
lgpl-3 lgplv3
lgpl-2.1 lgpl 2 1
lgpl-3 lgpl 3 0
agpl-3 gnu affero general public license(?: agpl)? v(?:ersion)? ?3(?: 0)?
agpl-3 agplv3
agpl-3 agpl 3 0
gfdl gnu free documentation license v(?:ersion)? ?1 [123]
apache-1.0 apache (?:software )?license v(?:ersion)? ?1 0
apache-1.1 apache (?:software )?license v(?:ersion)? ?1 1
apache-2.0 apache (?:software )?license v(?:ersion)? ?2(?: 0)?
apache-2.0 apache (?:software )?license 2 0
apache-2.0 apache 2 0
apache-2.0 apache org licenses license 2 0
apache-1.1 apache org licenses license 1 1
mit opensource org licen[sc]es? mit
isc opensource org licen[sc]es? isc
bsd-2-clause opensource org licen[sc]es? bsd 2 clause
bsd-3-clause opensource org licen[sc]es? bsd 3 clause
apache-2.0 opensource org licen[sc]es? apache 2 0
gpl-2 opensource org licen[sc]es? gpl 2 0
gpl-3 opensource org licen[sc]es? gpl 3 0
lgpl-2.1 opensource org licen[sc]es? lgpl 2 1
mpl-2.0 opensource org licen[sc]es? mpl 2 0
zlib opensource org licen[sc]es? zlib
cc-by creativecommons org licenses by [1234] [05]
cc-by-sa creativecommons org licenses by sa [1234] [05]
cc-by-nc creativecommons org licenses by nc [1234] [05]
cc-by-nd creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd creativecommons org licenses by nc nd [1234] [05]
cc0-1.0 creativecommons org publicdomain zero 1 0
public-domain creativecommons org publicdomain mark 1 0
mpl-2.0 mozilla org mpl 2 0
mpl-1.1 mozilla org mpl mpl 1 1
epl-1.0 eclipse org legal epl v10
epl-2.0 eclipse org legal epl 2 0
odbl-1.0 opendatacommons org licenses odbl
odc-by-1.0 opendatacommons org licenses by
pddl-1.0 opendatacommons org licenses pddl
cc-by cc by [1234] [05]
cc-by-sa cc by sa(?: [1234] [05])?
cc-by-nc cc by nc(?: [1234] [05])?
cc-by-nd cc by nd(?: [1234] [05])?
cc-by-nc-sa cc by nc sa(?: [1234] [05])?
cc-by-nc-nd cc by nc nd(?: [1234] [05])?
cc0-1.0 cc0(?: 1 0)?
cc-by creative commons attribution [1234] [05]
cc-by creative commons attribution [1234] [05] international license
cc-by-sa creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nc creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nd creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc-by-nc-sa creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc0-1.0 creative commons zero(?: v)?(?: ?1 0)?
bsd-2-clause bsd 2 clause
bsd-3-clause bsd 3 clause
bsd-4-clause bsd 4 clause
bsd-2-clause simplified bsd
bsd-2-clause freebsd license
bsd-3-clause modified bsd
bsd-3-clause revised bsd
bsd-4-clause original bsd
mpl-1.0 mozilla public license v(?:ersion)? ?1 0
mpl-1.1 mozilla public license v(?:ersion)? ?1 1
mpl-2.0 mozilla public license v(?:ersion)? ?2 0
epl-1.0 eclipse public license v(?:ersion)? ?1 0
epl-2.0 eclipse public license v(?:ersion)? ?2 0
eupl-1.1 european union public licen[sc]e v(?:ersion)? ?1 1
eupl-1.2 european union public licen[sc]e v(?:ersion)? ?1 2
cddl-1.0 common development and distribution license(?: cddl)? v(?:ersion)? ?1 0
cddl-1.1 common development and distribution license(?: cddl)? v(?:ersion)? ?1 1
cpl-1.0 common public license v(?:ersion)? ?1 0
artistic-2.0 artistic license v?(?:ersion)? ?2 0
artistic-1.0 artistic license v?(?:ersion)? ?1 0
afl-3.0 academic free license v(?:ersion)? ?3 0
osl-3.0 open software license v(?:ersion)? ?3 0
ofl-1.1 sil open font license v(?:ersion)? ?1 1
bsl-1.0 boost software license v(?:ersion)? ?1 0
busl-1.1 business source license v?(?:ersion)? ?1 1
sspl-1.0 server side public license v(?:ersion)? ?1
elastic-2.0 elastic license v?(?:ersion)? ?2(?: 0)?
odbl-1.0 open (?:data commons open )?database license v?(?:ersion)? ?1 0
odc-by-1.0 open data commons attribution license
pddl-1.0 open data commons public domain dedication
psf-2.0 python software foundation license v(?:ersion)? ?2
php-3.01 php license v(?:ersion)? ?3 01
zpl-2.1 zope public license v(?:ersion)? ?2 1
ecl-2.0 educational community license v(?:ersion)? ?2 0
upl-1.0 universal permissive license v(?:ersion)? ?1 0
mulan-psl-2.0 mulan permissive software license v(?:ersion)? ?2
"""),
    # sentences that put a work under a license
    (2, 0.8, """
mit licen[sc]ed under the mit licen[sc]e
mit released under the mit licen[sc]e
mit distributed under the mit licen[sc]e
mit available under the mit licen[sc]e
apache licensed under the apache licen[sc]e
apache released under the apache licen[sc]e
apache distributed under the apache licen[sc]e
gpl licensed under the (?:terms of the )?gnu general public licen[sc]e
gpl released under the (?:terms of the )?gnu general public licen[sc]e
gpl distributed under the (?:terms of the )?gnu general public licen[sc]e
gpl licensed under the gpl
lgpl licensed under the (?:terms of the )?gnu lesser general public licen[sc]e
agpl licensed under the (?:terms of the )?gnu affero general public licen[sc]e
bsd licensed under (?:the |a )?bsd
bsd released under (?:the |a )?bsd
mpl licensed under the mozilla public
cc-by licensed under cc by
cc-by licensed under a creative commons attribution
creative-commons licensed under a creative commons
public-domain dedicated to the public domain
public-domain released into the public domain
public-domain placed in the public domain
dual dual licen[sc]ed under
proprietary licensed under a (?:commercial|proprietary) licen[sc]e
perl perl itself
"""),
    # names
    (1, 0.6, """
gpl gnu general public licen[sc]e
gpl gnu gpl
gpl general public licen[sc]e
lgpl gnu lesser general public licen[sc]e
lgpl gnu library general public licen[sc]e
lgpl lesser general public licen[sc]e
lgpl lgpl
agpl gnu affero general public licen[sc]e
agpl affero general public licen[sc]e
agpl agpl
gfdl gnu free documentation licen[sc]e
apache apache (?:software )?licen[sc]e
mit mit licen[sc]e
mit expat licen[sc]e
mit-0 mit no attribution
x11 x11 licen[sc]e
isc isc licen[sc]e
zlib zlib (?:libpng )?licen[sc]e
bsd bsd (?:style )?licen[sc]e
bsd berkeley software distribution licen[sc]e
mpl mozilla public licen[sc]e
epl eclipse public licen[sc]e
eupl european union public licen[sc]e
cddl common development and distribution licen[sc]e
cpl common public licen[sc]e
artistic artistic licen[sc]e
afl academic free licen[sc]e
osl open software licen[sc]e
ofl open font licen[sc]e
bsl-1.0 boost software licen[sc]e
busl business source licen[sc]e
sspl server side public licen[sc]e
elastic elastic licen[sc]e
unlicense unlicense
wtfpl wtfpl
odbl open database licen[sc]e
psf python software foundation licen[sc]e
php php licen[sc]e
zpl zope public licen[sc]e
ruby ruby licen[sc]e
postgresql postgresql licen[sc]e
openssl openssl licen[sc]e
ncsa ncsa open source licen[sc]e
ms-pl microsoft public licen[sc]e
ms-rl microsoft reciprocal licen[sc]e
cc-by cc by
cc-by creative commons attribution
cc-by-sa creative commons share ?alike
creative-commons creative commons licen[sc]e
public-domain public domain dedication
beerware beer ?ware licen[sc]e
vim vim licen[sc]e
curl curl licen[sc]e
w3c w3c software (?:notice and )?licen[sc]e
"""),
    # weak signs
    (0, 0.3, """
unknown-license licen[sc]e
unknown-license licen[sc]ed under
unknown-license licen[sc]ing terms
unknown-copyright copyright c? ?(?:19|20)[0-9][0-9]
proprietary rights reserved
gpl gpl
"""),
]


def _rules() -> list[Rule]:
    found = []
    for priority, weight, lines in _SECTIONS:
        for line in lines.strip().split("\n"):
            label, pattern = line.split(" ", 1)
            word = re.match(r"(?:[0-9a-z]|\[sc\])+", pattern).group()
            # a spelling with c and one with s are two keywords of one rule
            for keyword in ([word.replace("[sc]", c) for c in "sc"] if "[sc]" in word else [word]):
                found.append(Rule(len(found), keyword, keyword + pattern[len(word):], label, priority, weight))
    return found


RULES = _rules()

#: Phrases that every scan counts, whatever the rules say: words, label.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
BASE_WEIGHT = 0.6
