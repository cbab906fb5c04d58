"""How licenses are stated in short: single rules, each written for one way of saying one license.

A line is label, priority, weight, keyword and pattern over words (lower case, other characters as one blank). The keyword
stands in whatever the pattern matches. A rule without a label says that a license is not given: it only suppresses.
"""

LINES = """
gpl-3.0 | 2 | 0.95 | gplv3 | (licensed|released|distributed|available|published) under (the )?(terms of )?(the )?(gnu )?gplv3( or later)?
gpl-3.0 | 3 | 0.85 | gplv3 | gplv3( or later)? licensed?
gpl-3.0 | 4 | 0.6 | gplv3 | gplv3
gpl-3.0 | 2 | 0.95 | gpl v3 | (licensed|released|distributed|available|published) under (the )?(terms of )?(the )?(gnu )?gpl v3( 0)?( or later)?
gpl-3.0 | 4 | 0.6 | gpl v3 | gpl v3
gpl-3.0 | 2 | 0.95 | gpl version 3 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?gpl version 3( 0)?( or later)?
gpl-3.0 | 3 | 0.8 | gpl version 3 | gnu gpl version 3( 0)?( or later)?
gpl-3.0 | 4 | 0.6 | gpl version 3 | gpl version 3
gpl-3.0 | 2 | 0.95 | gpl 3 | (license|licence) gpl 3( 0)?( only| or later)?
gpl-3.0 | 4 | 0.7 | gpl 3 0 | gpl 3 0( only| or later)?
gpl-3.0 | 2 | 0.9 | gpl 3 | licensed under (the )?(terms of )?(the )?(gnu )?gpl 3( 0)?
gpl-3.0 | 2 | 0.95 | gplv3 | (license|licence) gplv3( or later)?
gpl-3.0 | 2 | 0.95 | gnu general public license | gnu general public license as published by the free software foundation either version 3
gpl-2.0 | 2 | 0.95 | gplv2 | (licensed|released|distributed|available|published) under (the )?(terms of )?(the )?(gnu )?gplv2( or later)?
gpl-2.0 | 3 | 0.85 | gplv2 | gplv2( or later)? licensed?
gpl-2.0 | 4 | 0.6 | gplv2 | gplv2
gpl-2.0 | 2 | 0.95 | gpl v2 | (licensed|released|distributed|available|published) under (the )?(terms of )?(the )?(gnu )?gpl v2( 0)?( or later)?
gpl-2.0 | 4 | 0.6 | gpl v2 | gpl v2
gpl-2.0 | 2 | 0.95 | gpl version 2 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?gpl version 2( 0)?( or later)?
gpl-2.0 | 3 | 0.8 | gpl version 2 | gnu gpl version 2( 0)?( or later)?
gpl-2.0 | 4 | 0.6 | gpl version 2 | gpl version 2
gpl-2.0 | 2 | 0.95 | gpl 2 | (license|licence) gpl 2( 0)?( only| or later)?
gpl-2.0 | 4 | 0.7 | gpl 2 0 | gpl 2 0( only| or later)?
gpl-2.0 | 2 | 0.9 | gpl 2 | licensed under (the )?(terms of )?(the )?(gnu )?gpl 2( 0)?
gpl-2.0 | 2 | 0.95 | gplv2 | (license|licence) gplv2( or later)?
gpl-2.0 | 2 | 0.95 | gnu general public license | gnu general public license as published by the free software foundation either version 2
gpl | 3 | 0.85 | gpl | (licensed|released|distributed|available|published) under (the )?(terms of )?(the )?gpl
gpl | 3 | 0.8 | gpl | gpl licensed
gpl | 3 | 0.8 | gpl | (license|licence) gpl
gpl | 4 | 0.6 | gpl license | gpl license
gpl | 4 | 0.6 | gpl compatible | gpl compatible
lgpl-2.1 | 2 | 0.95 | lgplv2 1 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?lgplv2 1
lgpl-2.1 | 3 | 0.85 | lgplv2 1 | lgplv2 1( license)?
lgpl-2.1 | 2 | 0.95 | lgpl 2 1 | (license|licence) lgpl 2 1( only| or later)?
lgpl-2.1 | 4 | 0.7 | lgpl 2 1 | lgpl 2 1( only| or later)?
lgpl-2.1 | 3 | 0.85 | lgpl v2 1 | lgpl v2 1
lgpl-2.1 | 3 | 0.85 | lgpl version 2 1 | lgpl version 2 1
lgpl-3.0 | 2 | 0.95 | lgplv3 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?lgplv3
lgpl-3.0 | 3 | 0.85 | lgplv3 | lgplv3( license)?
lgpl-3.0 | 2 | 0.95 | lgpl 3 0 | (license|licence) lgpl 3 0( only| or later)?
lgpl-3.0 | 4 | 0.7 | lgpl 3 0 | lgpl 3 0( only| or later)?
lgpl-3.0 | 3 | 0.85 | lgpl v3 | lgpl v3
lgpl-3.0 | 3 | 0.85 | lgpl version 3 | lgpl version 3
lgpl | 3 | 0.85 | lgpl | (licensed|released|distributed|available) under (the )?(terms of )?(the )?lgpl
lgpl | 3 | 0.8 | lgpl | (license|licence) lgpl
lgpl | 4 | 0.6 | lgpl | lgpl license
agpl-3.0 | 2 | 0.95 | agplv3 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?agplv3
agpl-3.0 | 3 | 0.85 | agplv3 | agplv3( license)?
agpl-3.0 | 2 | 0.95 | agpl 3 0 | (license|licence) agpl 3 0( only| or later)?
agpl-3.0 | 4 | 0.7 | agpl 3 0 | agpl 3 0( only| or later)?
agpl-3.0 | 3 | 0.85 | agpl v3 | agpl v3
agpl-3.0 | 3 | 0.85 | agpl version 3 | agpl version 3
agpl | 3 | 0.85 | agpl | (licensed|released|distributed|available) under (the )?(terms of )?(the )?agpl
agpl | 3 | 0.8 | agpl | (license|licence) agpl
mit | 2 | 0.95 | under the mit | (licensed|released|distributed|available|published) under the mit
mit | 2 | 0.9 | under mit | (licensed|released|distributed|available|published) under mit
mit | 2 | 0.95 | license mit | license mit
mit | 2 | 0.95 | licence mit | licence mit
mit | 3 | 0.85 | mit licensed | mit licensed
mit | 3 | 0.85 | licensed mit | licensed mit
mit | 3 | 0.85 | mit licence | mit licence
mit | 3 | 0.8 | mit style license | mit style license
mit | 3 | 0.8 | mit style licence | mit style licence
mit | 3 | 0.9 | terms of the mit | under the terms of the mit
mit | 3 | 0.85 | mit or apache 2 0 | mit or apache 2 0
apache-2.0 | 3 | 0.85 | mit or apache 2 0 | mit or apache 2 0
apache-2.0 | 3 | 0.85 | mit apache 2 0 | mit apache 2 0
mit | 3 | 0.85 | mit apache 2 0 | mit apache 2 0
mit | 3 | 0.85 | apache 2 0 mit | apache 2 0 mit
apache-2.0 | 3 | 0.85 | apache 2 0 mit | apache 2 0 mit
mit | 2 | 0.95 | dual licensed mit | dual licensed mit
mit | 2 | 0.9 | this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 3 | 0.7 | noninfringement in no event shall the authors | noninfringement in no event shall the authors or copyright holders be liable for any claim
apache-2.0 | 2 | 0.95 | apache 2 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?apache 2( 0)?
apache-2.0 | 2 | 0.95 | apache v2 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?apache v2( 0)?
apache-2.0 | 2 | 0.95 | apache | (license|licence) apache 2 0
apache-2.0 | 3 | 0.85 | apache version 2 0 | apache version 2 0
apache-2.0 | 3 | 0.85 | asl 2 0 | asl 2 0
apache-2.0 | 3 | 0.85 | apache 2 license | apache 2 license
apache-2.0 | 3 | 0.85 | apache 2 licensed | apache 2 licensed
apache-2.0 | 2 | 0.9 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license
apache | 3 | 0.85 | apache | (licensed|released|distributed|available) under (the )?(terms of )?(the )?apache
apache | 3 | 0.8 | apache licensed | apache licensed
apache | 3 | 0.8 | apache licence | apache licence
apache | 3 | 0.8 | license apache | license apache
bsd-3-clause | 3 | 0.85 | 3 clause bsd | 3 clause bsd( license| licence)?
bsd-3-clause | 3 | 0.85 | three clause bsd | three clause bsd( license| licence)?
bsd-3-clause | 2 | 0.95 | bsd 3 clause | (license|licence) bsd 3 clause
bsd-3-clause | 3 | 0.85 | bsd3 | bsd3( license)?
bsd-3-clause | 3 | 0.8 | new bsd | new bsd
bsd-3-clause | 3 | 0.8 | modified bsd | modified bsd
bsd-3-clause | 2 | 0.9 | may be used to endorse or promote products | nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2-clause | 3 | 0.85 | 2 clause bsd | 2 clause bsd( license| licence)?
bsd-2-clause | 3 | 0.85 | two clause bsd | two clause bsd( license| licence)?
bsd-2-clause | 2 | 0.95 | bsd 2 clause | (license|licence) bsd 2 clause
bsd-2-clause | 3 | 0.85 | bsd2 | bsd2( license)?
bsd-2-clause | 3 | 0.8 | simplified bsd | simplified bsd
bsd-2-clause | 3 | 0.8 | freebsd license | freebsd license
bsd-4-clause | 3 | 0.85 | 4 clause bsd | 4 clause bsd( license| licence)?
bsd-4-clause | 2 | 0.9 | must display the following acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | 2 | 0.85 | bsd | (licensed|released|distributed|available) under (the )?(terms of )?(the |a )?bsd
bsd | 3 | 0.8 | license bsd | license bsd
bsd | 3 | 0.8 | bsd licensed | bsd licensed
bsd | 3 | 0.8 | bsd licence | bsd licence
bsd | 2 | 0.9 | retain the above copyright notice | redistributions of source code must retain the above copyright notice
bsd | 2 | 0.9 | reproduce the above copyright notice | redistributions in binary form must reproduce the above copyright notice
0bsd | 3 | 0.85 | 0bsd | 0bsd
0bsd | 3 | 0.85 | zero clause bsd | zero clause bsd( license)?
isc | 2 | 0.95 | under the isc | (licensed|released|distributed|available) under the isc
isc | 2 | 0.95 | license isc | license isc
isc | 3 | 0.85 | isc licensed | isc licensed
isc | 3 | 0.85 | isc licence | isc licence
mpl-2.0 | 2 | 0.95 | mpl 2 0 | (licensed|released|distributed|available) under (the )?(terms of )?(the )?mpl 2 0
mpl-2.0 | 3 | 0.9 | terms of mpl 2 0 | under the terms of mpl 2 0
mpl-2.0 | 3 | 0.9 | terms of the mpl 2 0 | under the terms of the mpl 2 0
mpl-2.0 | 4 | 0.7 | mpl 2 0 | mpl 2 0
mpl-2.0 | 3 | 0.85 | mplv2 | mplv2( 0)?
mpl-2.0 | 3 | 0.85 | mpl v2 | mpl v2( 0)?
mpl-2.0 | 2 | 0.9 | subject to the terms of the mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 3 | 0.85 | mpl 1 1 | mpl 1 1
mpl | 2 | 0.85 | under the mpl | (licensed|released|distributed|available) under the mpl
mpl | 3 | 0.8 | license mpl | license mpl
epl-2.0 | 3 | 0.85 | epl 2 0 | epl 2 0
epl-2.0 | 3 | 0.85 | epl v2 | epl v2( 0)?
epl-1.0 | 3 | 0.85 | epl 1 0 | epl 1 0
epl-1.0 | 3 | 0.85 | epl v1 | epl v1( 0)?
eupl | 3 | 0.85 | eupl v1 | eupl v1( [0-9])?
eupl | 3 | 0.85 | eupl 1 2 | eupl 1 2
cddl | 3 | 0.85 | under the cddl | (licensed|released|distributed|available) under the cddl
cddl | 3 | 0.85 | cddl 1 | cddl 1 [0-9]
ms-pl | 3 | 0.85 | microsoft public license | microsoft public license
ms-pl | 3 | 0.85 | ms pl | license ms pl
ms-rl | 3 | 0.85 | microsoft reciprocal license | microsoft reciprocal license
zlib | 3 | 0.85 | license zlib | license zlib
zlib | 3 | 0.85 | under the zlib | (licensed|released|distributed|available) under the zlib
zlib | 2 | 0.9 | altered source versions must be plainly marked | altered source versions must be plainly marked as such
bsl-1.0 | 3 | 0.85 | bsl 1 0 | bsl 1 0
bsl-1.0 | 2 | 0.95 | license boost | license boost( 1 0)?
busl-1.1 | 3 | 0.85 | business source license | business source license( 1 1)?
sspl-1.0 | 3 | 0.85 | server side public license | server side public license
sspl-1.0 | 3 | 0.85 | sspl | (license|licensed under the|under the) sspl
elastic-2.0 | 3 | 0.85 | elastic license | elastic license( 2 0)?
unlicense | 2 | 0.95 | license unlicense | license unlicense
unlicense | 2 | 0.9 | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | 2 | 0.95 | license wtfpl | license wtfpl
artistic-2.0 | 3 | 0.85 | license artistic 2 0 | license artistic 2 0
psf-2.0 | 3 | 0.85 | license psf | license psf( 2 0)?
python-2.0 | 3 | 0.85 | python license | python license
ruby | 3 | 0.85 | ruby license | ruby license
php-3.01 | 3 | 0.85 | php license | php license( version| v)?( 3 01| 3 0)?
perl | 3 | 0.85 | same terms as perl itself | under the same terms as perl itself
vim | 3 | 0.85 | vim license | vim license
curl | 3 | 0.85 | curl license | curl license
ncsa | 3 | 0.85 | ncsa open source license | (university of illinois )?ncsa open source license
w3c | 3 | 0.85 | w3c software | w3c software( notice and)? license
ofl-1.1 | 3 | 0.85 | ofl 1 1 | ofl 1 1
ofl-1.1 | 3 | 0.85 | open font license | open font license( version| v)?( 1 1)?
afl-3.0 | 3 | 0.85 | academic free license | academic free license( version| v)?( 3 0)?
osl-3.0 | 3 | 0.85 | open software license | open software license( version| v)?( 3 0)?
cecill-2.1 | 3 | 0.85 | cecill | (license|licence) cecill( 2 1| b| c)?
gfdl | 3 | 0.85 | gfdl | (licensed under|under|license) (the )?gfdl
cc0-1.0 | 2 | 0.95 | cc0 | (license|licence) cc0( 1 0)?
cc0-1.0 | 3 | 0.85 | no rights reserved | no rights reserved
cc-by-sa | 3 | 0.85 | attribution sharealike | creative commons attribution sharealike [0-9] 0
cc-by-sa | 3 | 0.85 | ccbysa | ccbysa
cc-by | 3 | 0.85 | attribution 4 0 international | creative commons attribution 4 0 international
cc-by | 3 | 0.85 | attribution 3 0 unported | creative commons attribution 3 0 unported
cc-by-nc-sa | 3 | 0.85 | noncommercial sharealike | attribution noncommercial sharealike( [0-9] 0)?
cc-by-nc-nd | 3 | 0.85 | noncommercial noderivatives | attribution noncommercial noderivatives( [0-9] 0)?
odbl-1.0 | 3 | 0.85 | license odbl | license odbl
cdla-permissive | 3 | 0.85 | community data license agreement | community data license agreement( permissive)?
openrail | 3 | 0.85 | openrail | (creativeml )?openrail( m| ml)?
llama-community | 3 | 0.85 | community license agreement | llama [0-9] community license agreement
 | 1 | 0.0 | not licensed under | not licensed under (the )?(terms of )?(the )?(gnu )?[al]?gpl( ?v?[0-9]( [0-9])?)?
 | 1 | 0.0 | not licensed under | not licensed under (the )?(terms of )?(the )?mit
 | 1 | 0.0 | not licensed under | not licensed under (the )?(terms of )?(the )?apache( 2( 0)?)?
 | 1 | 0.0 | not licensed under | not licensed under (the )?(terms of )?(the )?bsd
 | 1 | 0.0 | not compatible with | not compatible with (the )?(gnu )?[al]?gpl( ?v?[0-9]( [0-9])?)?
 | 1 | 0.0 | no license | there is no license
 | 1 | 0.0 | no licence | there is no licence
"""


def stated() -> list[tuple[str, int, float, str, str]]:
    """The lines as rules: label, priority, weight, keyword, pattern."""
    parts = [[p.strip() for p in line.split("|", 4)] for line in LINES.strip("\n").split("\n")]
    return [(label, int(priority), float(weight), keyword, pattern) for label, priority, weight, keyword, pattern in parts]
