"""Written statements of licenses and the labels that they should get; none is made from the rules."""

import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import license_rules, license_scan

STATEMENTS = """
Licensed under GPLv3 => gpl-3.0
This project is released under GPL v2. => gpl-2.0
License: GPL-2.0-or-later => gpl-2.0
licensed under the GPL => gpl
GNU GPL version 3 => gpl-3.0
GNU GPL, version 2 or later => gpl-2.0
Distributed under the terms of the GNU GPL v3.0 => gpl-3.0
SPDX-License-Identifier: GPL-3.0-only => gpl-3.0
code is GPLv2 => gpl-2.0
Our code is GPL licensed. => gpl
you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License => gpl,gpl-3.0
GPL-compatible => gpl
LGPLv2.1 license => lgpl-2.1
released under the LGPL => lgpl
License: LGPL-3.0-or-later => lgpl-3.0
GNU Lesser General Public License v2.1 => lgpl-2.1
licensed under AGPLv3 => agpl-3.0
available under the AGPL => agpl
GNU Affero General Public License, version 3 => agpl-3.0
AGPL-3.0 => agpl-3.0
License: MIT => mit
license = "MIT" => mit
Licensed under the MIT => mit
MIT licensed => mit
The MIT License (MIT) => mit
released under MIT => mit
an MIT-style license => mit
under the terms of the MIT license => mit
MIT licence => mit
Permission is hereby granted, free of charge, to any person obtaining a copy of this software => mit
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. => mit
dual licensed MIT/Apache-2.0 => apache-2.0,mit
MIT OR Apache-2.0 => apache-2.0,mit
Apache-2.0/MIT => apache-2.0,mit
Licensed under the Apache License, Version 2.0 (the "License"); => apache,apache-2.0
License: Apache 2.0 => apache-2.0
released under Apache 2 => apache-2.0
Apache v2 is used; distributed under the Apache v2.0 => apache-2.0
you may not use this file except in compliance with the License. => apache-2.0
http://www.apache.org/licenses/LICENSE-2.0 => apache-2.0
Apache licensed => apache
3-clause BSD => bsd-3-clause
Three-Clause BSD License => bsd-3-clause
License: BSD-3-Clause => bsd-3-clause
modified BSD => bsd-3-clause
the new BSD license => bsd-3-clause
2-clause BSD licence => bsd-2-clause
simplified BSD => bsd-2-clause
BSD 2-Clause License => bsd-2-clause
Redistributions of source code must retain the above copyright notice => bsd
Redistributions in binary form must reproduce the above copyright notice => bsd
released under the BSD license => bsd
BSD-licensed => bsd
All advertising materials mentioning features or use of this software must display the following acknowledgement => bsd-4-clause
Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software => bsd-3-clause
0BSD License => 0bsd
ISC License => isc
License: ISC => isc
under the terms of MPL 2.0 => mpl-2.0
MPL-2.0 => mpl-2.0
Mozilla Public License, v. 2.0 => mpl-2.0
available under the MPL => mpl
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. => mpl-2.0
Eclipse Public License 2.0 => epl-2.0
EPL v1.0 => epl-1.0
EUPL v1.2 license => eupl
licensed under the CDDL => cddl
Microsoft Public License => ms-pl
zlib license => zlib
Altered source versions must be plainly marked as such => zlib
Boost Software License 1.0 => bsl-1.0
Business Source License 1.1 => busl-1.1
Server Side Public License => sspl-1.0
Elastic License 2.0 => elastic-2.0
This is free and unencumbered software released into the public domain. => unlicense
License: WTFPL => wtfpl
Artistic License 2.0 => artistic-2.0
PSF License => psf-2.0
under the same terms as Perl itself => perl
PHP License v3.01 => php-3.01
Vim license => vim
University of Illinois/NCSA Open Source License => ncsa
SIL Open Font License 1.1 => ofl-1.1
Academic Free License v3.0 => afl-3.0
GNU Free Documentation License => gfdl
CC0 1.0 => cc0-1.0
License: CC0-1.0 => cc0-1.0
Creative Commons Attribution-ShareAlike 4.0 => cc-by-sa
CC BY-NC 4.0 => cc-by,cc-by-nc
CC-BY-SA => cc-by,cc-by-sa
Creative Commons Attribution 4.0 International => cc-by
Creative Commons Attribution-NonCommercial-ShareAlike 4.0 => cc-by-nc-sa
https://creativecommons.org/licenses/by-sa/4.0/ => cc-by-sa
Open Database License => odbl-1.0
Community Data License Agreement - Permissive => cdla-permissive
CreativeML OpenRAIL-M => openrail
Llama 2 Community License Agreement => llama-community
All rights reserved. => proprietary
Proprietary and confidential => proprietary
not licensed under the MIT license => mit
This is no longer distributed under the ISC License =>
It is not licensed under GPLv3 =>
There is no license. =>
Wir sind mit dem Zug gefahren. =>
the mit was lost in the simple example => 
a permit, an omission and the public =>
"""


def test_statements_get_their_labels(spark):
    want = [tuple(x.strip() for x in line.split("=>")) for line in STATEMENTS.strip("\n").split("\n")]
    assert len(want) > 100
    rows = [(k, t) for k, (t, _) in enumerate(want)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t, got[k]) for k, (t, w) in enumerate(want) if got[k] != w] == []


def test_denials_score_low(spark):
    rows = [(1, "not licensed under the MIT license"), (2, "licensed under the MIT license"), (3, "It is not licensed under GPLv3."), (4, "Parts are not released under the Apache License, others are licensed under GPLv3.")]
    got = {r["doc_id"]: (r["score"], r["base_labels"], r["n_base"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0.0, "mit", 1), 2: (0.95, "mit", 1), 3: (0.0, "", 0), 4: (0.95, "apache", 1)}


def test_rules_are_separate():
    rules = license_rules.stated()
    assert len(rules) > 150 and len({(r[0], r[4]) for r in rules}) == len(rules)
