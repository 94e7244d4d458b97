"""Signature rules for licence scans, written by hand.

A rule is ``label | priority | keyword | pattern``.  Patterns are matched against the normalised text: the words of
the lower-cased text joined by single spaces, so that punctuation and line breaks never matter ("v2.0" reads
"v2 0", "GPL-3.0-or-later" reads "gpl 3 0 or later").  They match whole words only.  A rule is tried only where its
keyword occurs.  A higher priority wins over an overlapping detection that it contains.

In patterns, ``{v}`` stands for an optional "version"/"v", ``{lic}`` for an optional "under the ... license" lead.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

_TEXT = r"""
gpl-1.0|90|general public license|gnu general public license {v}1( 0)?
gpl-2.0|90|general public license|gnu general public license {v}2( 0)?
gpl-3.0|90|general public license|gnu general public license {v}3( 0)?
gpl-2.0-or-later|95|general public license|gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later|95|general public license|gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later|94|general public license|gnu general public license {v}2( 0)? or( at your option)?( any)? later( version)?
gpl-3.0-or-later|94|general public license|gnu general public license {v}3( 0)? or( at your option)?( any)? later( version)?
gpl-2.0-only|93|general public license|gnu general public license {v}2( 0)? only
gpl-3.0-only|93|general public license|gnu general public license {v}3( 0)? only
gpl-1.0|85|gpl|gpl( |)v?1( 0)?
gpl-2.0|85|gpl|gpl( |)v?2( 0)?
gpl-3.0|85|gpl|gpl( |)v?3( 0)?
gpl-2.0|86|gplv2|gplv2
gpl-3.0|86|gplv3|gplv3
gpl-2.0-or-later|91|gpl|gpl {v}2( 0)? or later
gpl-3.0-or-later|91|gpl|gpl {v}3( 0)? or later
gpl-2.0-only|91|gpl|gpl {v}2( 0)? only
gpl-3.0-only|91|gpl|gpl {v}3( 0)? only
gpl|40|gpl|(licensed|released|distributed|available) under (the )?(gnu )?gpl
gpl|50|general public license|(licensed|released|distributed|available) under (the )?(terms of the )?gnu general public license
gpl|30|general public license|general public license
gpl-2.0-with-classpath-exception|97|classpath exception|gpl( |)v?2( 0)? with( the)? classpath exception
gpl-with-classpath-exception|60|classpath exception|classpath exception
gpl-2.0-with-linking-exception|60|linking exception|gpl( |)v?2( 0)? with( a)? linking exception
gpl-with-autoconf-exception|60|autoconf exception|autoconf exception
gpl-with-bison-exception|60|bison exception|bison exception
gpl-with-gcc-exception|60|runtime library exception|gcc runtime library exception
gpl-with-font-exception|60|font exception|gpl( with)? font exception
lgpl-2.0|92|library general public license|gnu library general public license {v}2( 0)?
lgpl-2.1|92|lesser general public license|gnu lesser general public license {v}2 1
lgpl-3.0|92|lesser general public license|gnu lesser general public license {v}3( 0)?
lgpl-2.1-or-later|96|lesser general public license|gnu lesser general public license {v}2 1 or( at your option)?( any)? later( version)?
lgpl-3.0-or-later|96|lesser general public license|gnu lesser general public license {v}3( 0)? or( at your option)?( any)? later( version)?
lgpl-2.1-or-later|96|lesser general public license|gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later|96|lesser general public license|gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl|55|lesser general public license|(gnu )?lesser general public license
lgpl|55|library general public license|(gnu )?library general public license
lgpl-2.0|87|lgpl|lgpl( |)v?2( 0)?
lgpl-2.1|88|lgpl|lgpl( |)v?2 1
lgpl-3.0|87|lgpl|lgpl( |)v?3( 0)?
lgpl-2.1-or-later|91|lgpl|lgpl 2 1 or later
lgpl-3.0-or-later|91|lgpl|lgpl 3( 0)? or later
lgpl-2.1-only|91|lgpl|lgpl 2 1 only
lgpl-3.0-only|91|lgpl|lgpl 3( 0)? only
lgpl|40|lgpl|(licensed|released|distributed|available) under (the )?lgpl
agpl-1.0|92|affero general public license|affero general public license {v}1( 0)?
agpl-3.0|92|affero general public license|gnu affero general public license {v}3( 0)?
agpl-3.0-or-later|96|affero general public license|gnu affero general public license {v}3( 0)? or( at your option)?( any)? later( version)?
agpl-3.0-or-later|96|affero general public license|gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl|55|affero general public license|(gnu )?affero general public license
agpl-3.0|87|agpl|agpl( |)v?3( 0)?
agpl-3.0-or-later|91|agpl|agpl 3( 0)? or later
agpl-3.0-only|91|agpl|agpl 3( 0)? only
gfdl-1.1|90|free documentation license|gnu free documentation license {v}1 1
gfdl-1.2|90|free documentation license|gnu free documentation license {v}1 2
gfdl-1.3|90|free documentation license|gnu free documentation license {v}1 3
gfdl|60|free documentation license|(gnu )?free documentation license
gfdl-no-invariant|70|no invariant sections|no invariant sections( no)? (with no )?front cover texts( and( with)? no back cover texts)?
gpl-notice|45|without even the implied warranty|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu( lesser| affero| library)? general public license
apache-1.0|90|apache|apache (software )?license {v}1 0
apache-1.1|90|apache|apache (software )?license {v}1 1
apache-2.0|90|apache|apache (software )?license {v}2( 0)?
apache-2.0|88|apache|apache( |)v?2( 0)?
apache-2.0|95|apache|licensed under the apache license {v}2( 0)?( the license)?
apache-2.0|96|apache org licenses license 2 0|(http|https) www apache org licenses license 2 0
apache-2.0|60|you may not use this file except in compliance|you may not use this file except in compliance with the license
apache-2.0|55|unless required by applicable law|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0-with-llvm-exception|97|llvm exception|apache( license)?( version)? 2 0 with llvm exceptions?
apache|30|apache|apache (software )?license
apache-notice|35|apache software foundation|(developed|software) (by|at) the apache software foundation
ecl-2.0|90|educational community license|educational community license {v}2( 0)?
ecl-1.0|90|educational community license|educational community license {v}1( 0)?
mit|60|mit|mit license
mit|70|mit|(licensed|released|distributed|available) under (the )?(terms of the )?mit license
mit|65|mit|(licensed|released|distributed|available) under (the )?mit
mit|80|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|75|sublicense and or sell copies|use copy modify merge publish distribute sublicense and or sell copies
mit-0|85|mit|mit no attribution( license)?
mit-advertising|85|mit|mit license with advertising( clause)?
mit-modern|85|mit|mit license modern variant
x11|85|x11|(the )?x11 license
x11|70|x consortium|x consortium shall not be used in advertising
x-net|80|x net license|x net license
expat|80|expat|expat license
isc|85|isc|(the )?isc license
isc|75|permission to use copy modify and or distribute|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc-old|72|permission to use copy modify and distribute|permission to use copy modify and distribute this software( and its documentation)? for any purpose (and )?(with or )?without fee is hereby granted
hpnd|60|hpnd|hpnd( license)?
hpnd|70|historical permission notice|historical permission notice and disclaimer
bsd-0-clause|88|bsd|(0|zero) clause bsd( license)?
bsd-1-clause|88|bsd|bsd 1 clause( license)?
bsd-2-clause|88|bsd|bsd 2 clause( license)?
bsd-2-clause|88|bsd|(2|two) clause bsd( license)?
bsd-2-clause|85|bsd|simplified bsd license
bsd-2-clause|85|freebsd|freebsd license
bsd-2-clause-patent|92|bsd|bsd 2 clause( plus)? patent( license)?
bsd-3-clause|88|bsd|bsd 3 clause( license)?
bsd-3-clause|88|bsd|(3|three) clause bsd( license)?
bsd-3-clause|85|bsd|(modified|new|revised) bsd license
bsd-3-clause-clear|92|bsd|bsd 3 clause clear( license)?
bsd-3-clause-lbnl|92|bsd|lawrence berkeley national labs? bsd( variant)?( license)?
bsd-4-clause|88|bsd|bsd 4 clause( license)?
bsd-4-clause|88|bsd|(4|four) clause bsd( license)?
bsd-4-clause|85|bsd|(original|old) bsd license
bsd-4-clause|78|all advertising materials mentioning|all advertising materials mentioning features or use of this software must display
bsd-3-clause|74|neither the name|neither the names? of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-2-clause|70|redistribution and use in source and binary forms|redistribution and use in source and binary forms with or without modification are permitted
bsd|40|bsd|bsd( style)? license
bsd|40|bsd|(licensed|released|distributed|available) under (the )?(a )?bsd
bsd-disclaimer|35|this software is provided by|this software is provided by .{1,80}? as is and any express or implied warranties
bsd-protection|88|bsd protection license|bsd protection license
mpl-1.0|90|mozilla public license|mozilla public license {v}1( 0)?
mpl-1.1|91|mozilla public license|mozilla public license {v}1 1
mpl-2.0|90|mozilla public license|mozilla public license {v}2( 0)?
mpl|60|mozilla public license|mozilla public license
mpl-1.1|85|mpl|mpl( |)v?1 1
mpl-2.0|84|mpl|mpl( |)v?2( 0)?
mpl-2.0-no-copyleft-exception|92|incompatible with secondary licenses|incompatible with secondary licenses( as defined by the mozilla public license v 2 0)?
npl-1.1|88|netscape public license|netscape public license {v}1 1
npl-1.0|87|netscape public license|netscape public license {v}1( 0)?
epl-1.0|90|eclipse public license|eclipse public license {v}1( 0)?
epl-2.0|90|eclipse public license|eclipse public license {v}2( 0)?
epl|60|eclipse public license|eclipse public license
epl-2.0|84|epl|epl {v}2 0
epl-1.0|84|epl|epl {v}1 0
edl-1.0|88|eclipse distribution license|eclipse distribution license( {v}1( 0)?)?
cpl-1.0|88|common public license|common public license( {v}1( 0)?)?
ipl-1.0|88|ibm public license|ibm public license( {v}1( 0)?)?
cddl-1.0|90|common development and distribution license|common development and distribution license( cddl)? {v}1( 0)?
cddl-1.1|91|common development and distribution license|common development and distribution license( cddl)? {v}1 1
cddl|60|common development and distribution license|common development and distribution license
cddl-1.0|84|cddl|cddl {v}1 0
cddl-1.1|84|cddl|cddl {v}1 1
eupl-1.0|88|european union public licen|european union public licen[cs]e {v}1 0
eupl-1.1|88|european union public licen|european union public licen[cs]e {v}1 1
eupl-1.2|88|european union public licen|european union public licen[cs]e {v}1 2
eupl|60|european union public licen|european union public licen[cs]e
eupl-1.2|80|eupl|eupl {v}1 2
eupl-1.1|80|eupl|eupl {v}1 1
cecill-1.0|86|cecill|cecill {v}1( 0)?
cecill-2.0|86|cecill|cecill {v}2( 0)?
cecill-2.1|87|cecill|cecill {v}2 1
cecill-b|86|cecill|cecill b
cecill-c|86|cecill|cecill c
cecill|50|cecill|cecill( free software)? license( agreement)?
artistic-1.0|88|artistic license|artistic license {v}1( 0)?
artistic-2.0|88|artistic license|artistic license {v}2( 0)?
artistic-1.0-perl|90|artistic license|(the )?perl artistic license
artistic|55|artistic license|artistic license
perl|70|same terms as perl|(under|on) the same terms as perl itself
ruby|70|same terms as ruby|(under|on) the same terms as ruby
ruby|70|ruby license|ruby license
python-2.0|85|python software foundation license|python software foundation license( {v}2( 0)?)?
python-2.0|80|psf license|psf license( agreement)?
python-cnri|85|cnri|cnri( open source)?( python)? license( agreement)?
php-3.0|86|php license|php license {v}3( 0)?
php-3.01|87|php license|php license {v}3 01
php|55|php license|php license
zend-2.0|86|zend|zend (engine )?license( {v}2( 0)?)?
zlib|85|zlib|zlib( libpng)? license
zlib|75|altered source versions must be plainly marked|altered source versions must be plainly marked as such and must not be misrepresented
libpng|85|libpng|libpng license( {v}2)?
libpng|85|png reference library|png reference library license( {v}2)?
libtiff|80|libtiff|libtiff license
ijg|80|independent jpeg group|(this software is based in part on the work of the )?independent jpeg group
info-zip|80|info zip|info zip license
bzip2|80|bzip2|bzip2( and libbzip2)? license
curl|80|curl license|curl license
openssl|85|openssl|openssl license
openssl|78|openssl project|this product includes software developed by the openssl project
ssleay|80|ssleay|ssleay license
openldap-2.8|85|openldap|openldap public license( {v}2 8)?
ntp|80|ntp license|ntp license
tcl|80|tcl|tcl tk license
vim|80|vim license|vim license
unicode|82|unicode|unicode( inc)? license agreement( data files and software)?
unicode-3.0|84|unicode license v3|unicode license v3
icu|82|icu license|icu license
w3c|85|w3c|w3c software( notice)?( and document)?( notice)?( and)? license
w3c-document|84|w3c|w3c document license
ofl-1.0|88|open font license|(sil )?open font license {v}1 0
ofl-1.1|88|open font license|(sil )?open font license {v}1 1
ofl|60|open font license|(sil )?open font license
bitstream-vera|82|bitstream vera|bitstream vera( fonts)?( copyright| license)
ubuntu-font-1.0|84|ubuntu font|ubuntu font licen[cs]e( {v}1( 0)?)?
freetype|84|freetype|(the )?freetype( project)? license
boost-1.0|88|boost software license|boost software license( {v}1( 0)?)?
boost-1.0|84|bsl 1 0|bsl 1 0
busl-1.1|86|business source license|business source license( {v}1 1)?
sspl-1.0|86|server side public license|server side public license( {v}1)?
elastic-2.0|86|elastic license|elastic license( {v}2( 0)?)?
commons-clause|84|commons clause|commons clause( license condition)?( {v}1 0)?
confluent-community-1.0|84|confluent community license|confluent community license( agreement)?( {v}1 0)?
polyform-noncommercial-1.0.0|86|polyform|polyform noncommercial license( 1 0 0)?
polyform-small-business-1.0.0|86|polyform|polyform small business license( 1 0 0)?
polyform-shield-1.0.0|86|polyform|polyform shield license( 1 0 0)?
prosperity-3.0.0|84|prosperity public license|prosperity public license( 3 0 0)?
parity-7.0.0|84|parity public license|parity public license( 7 0 0)?
hippocratic-2.1|84|hippocratic license|hippocratic license( {v}?2 1)?
osl-1.0|86|open software license|open software license {v}1( 0)?
osl-2.0|86|open software license|open software license {v}2( 0)?
osl-2.1|87|open software license|open software license {v}2 1
osl-3.0|86|open software license|open software license {v}3( 0)?
osl|55|open software license|open software license
afl-2.1|87|academic free license|academic free license {v}2 1
afl-3.0|86|academic free license|academic free license {v}3( 0)?
afl|55|academic free license|academic free license
rpl-1.5|86|reciprocal public license|reciprocal public license( {v}1 5)?
ms-pl|86|microsoft public license|microsoft public license( ms pl)?
ms-rl|86|microsoft reciprocal license|microsoft reciprocal license( ms rl)?
ms-pl|80|ms pl|ms pl
ms-limited-public|86|microsoft limited public license|microsoft limited public license
ncsa|86|ncsa|(university of illinois )?(ncsa )?ncsa open source license
uiuc|84|university of illinois|university of illinois( ncsa)? open source license
upl-1.0|86|universal permissive license|universal permissive license( {v}1 0)?
sleepycat|84|sleepycat|sleepycat( public)? license
postgresql|85|postgresql|postgresql licen[cs]e
qpl-1.0|85|q public license|q public license( {v}1 0)?
sun-sissl|84|sun industry standards|sun industry standards source license( {v}1 1)?
spl-1.0|84|sun public license|sun public license( {v}1 0)?
apsl-1.0|84|apple public source license|apple public source license {v}1( 0)?
apsl-2.0|85|apple public source license|apple public source license {v}2( 0)?
apsl|60|apple public source license|apple public source license
nasa-1.3|85|nasa open source agreement|nasa open source agreement( {v}1 3)?
nokia|82|nokia open source license|nokia open source license( {v}1 0a)?
realnetworks-1.0|82|realnetworks public source license|realnetworks public source license( {v}1 0)?
motosoto|82|motosoto|motosoto open source license
intel|82|intel open source license|intel open source license
lucent-1.02|84|lucent public license|lucent public license( {v}1 02)?
lppl-1.3c|86|latex project public license|latex project public license( {v}1 3c?)?
wtfpl|86|do what the fuck|do what the fuck you want to( public license)?
wtfpl|82|wtfpl|wtfpl
beerware|84|beer|(the )?beer ?ware license
unlicense|86|unlicense|(the )?unlicense
unlicense|80|free and unencumbered software|this is free and unencumbered software released into the public domain
public-domain|60|public domain|(dedicated|released|placed|is)( to| into| in) the public domain
public-domain|30|public domain|public domain
cc0-1.0|88|cc0|cc0( 1 0)?( universal)?
cc0-1.0|86|creative commons zero|creative commons zero( {v}1 0)?( universal)?
cc-pddc|84|public domain dedication|(creative commons )?public domain dedication( and certification)?
pddl-1.0|84|public domain dedication and license|open data commons public domain dedication and license
odbl-1.0|86|open database license|open database license( odbl)?( {v}1 0)?
odc-by-1.0|86|open data commons attribution|open data commons attribution license( {v}1 0)?
cc-by|50|cc by|cc by
cc-by-1.0|80|cc by|cc by 1 0
cc-by-2.0|80|cc by|cc by 2 0
cc-by-2.5|80|cc by|cc by 2 5
cc-by-3.0|80|cc by|cc by 3 0
cc-by-4.0|80|cc by|cc by 4 0
cc-by-sa|82|cc by sa|cc by sa
cc-by-sa-1.0|88|cc by sa|cc by sa 1 0
cc-by-sa-2.0|88|cc by sa|cc by sa 2 0
cc-by-sa-2.5|88|cc by sa|cc by sa 2 5
cc-by-sa-3.0|88|cc by sa|cc by sa 3 0
cc-by-sa-4.0|88|cc by sa|cc by sa 4 0
cc-by-nc|82|cc by nc|cc by nc
cc-by-nc-2.0|88|cc by nc|cc by nc 2 0
cc-by-nc-3.0|88|cc by nc|cc by nc 3 0
cc-by-nc-4.0|88|cc by nc|cc by nc 4 0
cc-by-nd|82|cc by nd|cc by nd
cc-by-nd-3.0|88|cc by nd|cc by nd 3 0
cc-by-nd-4.0|88|cc by nd|cc by nd 4 0
cc-by-nc-sa|84|cc by nc sa|cc by nc sa
cc-by-nc-sa-3.0|90|cc by nc sa|cc by nc sa 3 0
cc-by-nc-sa-4.0|90|cc by nc sa|cc by nc sa 4 0
cc-by-nc-nd|84|cc by nc nd|cc by nc nd
cc-by-nc-nd-3.0|90|cc by nc nd|cc by nc nd 3 0
cc-by-nc-nd-4.0|90|cc by nc nd|cc by nc nd 4 0
cc-by-4.0|82|creative commons attribution|creative commons attribution {v}?4 0( international)?( license)?
cc-by-3.0|82|creative commons attribution|creative commons attribution {v}?3 0( unported)?( license)?
cc-by-sa-4.0|89|creative commons attribution share|creative commons attribution share ?alike {v}?4 0( international)?( license)?
cc-by-sa-3.0|89|creative commons attribution share|creative commons attribution share ?alike {v}?3 0( unported)?( license)?
cc-by-nc-4.0|89|creative commons attribution non|creative commons attribution non ?commercial {v}?4 0( international)?( license)?
cc-by-nc-sa-4.0|91|creative commons attribution non|creative commons attribution non ?commercial share ?alike {v}?4 0( international)?( license)?
cc-by-nc-nd-4.0|91|creative commons attribution non|creative commons attribution non ?commercial no ?deriv(s|atives) {v}?4 0( international)?( license)?
cc-by-nd-4.0|89|creative commons attribution no|creative commons attribution no ?deriv(s|atives) {v}?4 0( international)?( license)?
cc-by|55|creative commons attribution|creative commons attribution( license)?
cc-by-4.0|84|creativecommons org licenses by|creativecommons org licenses by 4 0
cc-by-3.0|84|creativecommons org licenses by|creativecommons org licenses by 3 0
cc-by-sa-4.0|90|creativecommons org licenses by sa|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|90|creativecommons org licenses by sa|creativecommons org licenses by sa 3 0
cc-by-nc-4.0|90|creativecommons org licenses by nc|creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0|92|creativecommons org licenses by nc sa|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|92|creativecommons org licenses by nc nd|creativecommons org licenses by nc nd 4 0
cc0-1.0|90|creativecommons org publicdomain zero|creativecommons org publicdomain zero 1 0
creative-commons|40|creative commons|creative commons( license)?
spdx|45|spdx license identifier|spdx license identifier
mulan-psl-2.0|84|mulan|mulan( permissive software)? (license|psl)( v?2)?
openrail|82|openrail|(bigscience )?(creativeml )?openrail( m)?( license)?
openrail|82|open rail|(bigscience )?(creativeml )?open rail( m)?( license)?
llama-community|82|llama|llama( 2| 3| 3 1)? community license( agreement)?
gemma-terms|82|gemma|gemma terms of use
freeware|40|freeware|freeware license
shareware|40|shareware|shareware license
proprietary|50|proprietary and confidential|proprietary and confidential
proprietary|52|unauthorized copying|unauthorized copying of this file via any medium is strictly prohibited
commercial|45|commercial license|commercial license( agreement)?
commercial|45|proprietary license|proprietary license( agreement)?
eula|45|end user license agreement|end user license agreement
no-commercial-use|45|non commercial use only|(for )?non commercial use only
all-rights-reserved|20|all rights reserved|all rights reserved
copyright-notice|15|copyright|copyright( c)? (19|20)[0-9]{2}
warranty-disclaimer|15|provided as is|provided as is without( any)? warrant(y|ies)( of any kind)?
license-reference|10|see the license|see the license( file)? for( the)?( specific)?( language| details| more)?
license-reference|10|license file|(see )?(the )?license file
"""


def _rules() -> tuple[Rule, ...]:
    out = []
    for line in _TEXT.strip().splitlines():
        label, priority, keyword, pattern = line.split("|", 3)
        pattern = pattern.replace("{v}?", "(?:version |ver |v )?").replace("{v}", "(?:version |ver |v |v(?=[0-9]))?")
        out.append(Rule(label, int(priority), keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")))
    return tuple(out)


RULES = _rules()
"""In the order of the list, which breaks ties of equal priority and extent."""
