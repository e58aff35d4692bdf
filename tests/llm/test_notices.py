"""Licence notices as they stand in files, and what they state."""

import pytest

from colophon.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED.
"""
ENDORSE = "\n3. Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
APPEAR = ", provided that the above copyright notice and this permission notice appear in all copies"


def gnu(what, name, sep, version):
    return f"""{what} is free software{sep} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{version}

{what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


LATER = "{} version {} of the License, or\n(at your option) any later version."
NOTICES = [
    ("MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + MIT, "MIT"),
    ("/*\n" + "\n".join(" * " + x for x in MIT.splitlines()) + "\n */", "MIT"),
    ("Copyright 2019-2021 The Foo Authors. All rights reserved.\n\n" + MIT, "MIT"),
    (MIT.split("subject to")[0].rstrip(" ,\n") + ".\n\n" + MIT.split("Software.\n\n", 1)[1], "MIT-0"),
    ("Copyright (c) 2010, Acme Corp\nAll rights reserved.\n\n" + BSD.format(more=ENDORSE.format("Acme Corp", "its"), who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), "BSD-3-Clause"),
    (BSD.format(more=ENDORSE.format("the copyright holder", "its"), who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), "BSD-3-Clause"),
    (BSD.format(more=ENDORSE.format("the University nor of the Foo Group", "its"), who="THE REGENTS AND CONTRIBUTORS"), "BSD-3-Clause"),
    ("Copyright (c) 2001 J. Roe. All rights reserved.\n\n" + BSD.format(more="", who="THE AUTHOR AND CONTRIBUTORS"), "BSD-2-Clause"),
    (BSD.format(more="", who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), "BSD-2-Clause"),
    ("Copyright (c) 2015 J. Roe\n\n" + ISC.format(APPEAR), "ISC"),
    (ISC.format(APPEAR).replace("and/or", "and"), "ISC"),
    (ISC.format(""), "0BSD"),
    (gnu("This program", "General Public License", ":", ", " + LATER.format("either", 3)), "GPL-3.0-or-later"),
    (gnu("This program", "General Public License", ";", "; " + LATER.format("either", 2)), "GPL-2.0-or-later"),
    (gnu("Foo Tool", "General Public License", ":", ", " + LATER.format("either", 3)), "GPL-3.0-or-later"),
    (gnu("This library", "Lesser General Public License", ";", "; " + LATER.format("either", "2.1")), "LGPL-2.1-or-later"),
    (gnu("This library", "Lesser General Public License", ":", ", " + LATER.format("either", 3)), "LGPL-3.0-or-later"),
    (gnu("This program", "Affero General Public License", ":", ", " + LATER.format("either", 3)), "AGPL-3.0-or-later"),
    (gnu("This program", "General Public License", ";", "; version 2 of the License."), "GPL-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    ("Copyright (c) 1999 J. Roe\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    ('Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', "BSL-1.0"),
    ("To the extent possible under law, Jane Roe has waived all copyright and related or neighboring rights to this work.", "CC0-1.0"),
    ("Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.", "WTFPL"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    https://www.apache.org/licenses/LICENSE-2.0\n', "Apache-2.0"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("licensed under the MIT License, see LICENSE", "MIT"),
    ("This project is licensed under the MIT License - see the LICENSE.md file for details", "MIT"),
    ("The code is released under the terms of the MIT licence.", "MIT"),
    ("Foo is dual licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Distributed under the GNU GPL v3.", "GPL-3.0-only"),
    ("Released under the GPLv2 or later.", "GPL-2.0-or-later"),
    ("This work is licensed under the GNU General Public License version 3.", "GPL-3.0-only"),
    ("Available under the terms of the GNU Lesser General Public License v2.1.", "LGPL-2.1-only"),
    ("This file is distributed under the GNU General Public License version 2 or any later version.", "GPL-2.0-or-later"),
    ("Content is available under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Text is licensed under CC-BY-NC 4.0", "CC-BY-NC-4.0"),
    ("Licensed under CC0 1.0 Universal.", "CC0-1.0"),
    ("Licensed under the European Union Public Licence v. 1.2", ""),
    ("Fonts are licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("Released under the Artistic License 2.0.", "Artistic-2.0"),
    ("License: MIT", "MIT"),
    ("License: Apache 2.0\nAuthor: x", "Apache-2.0"),
    ("license: GPLv3", "GPL-3.0-only"),
    ("# SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0\npackage x;", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0-only"),
    ("<!-- SPDX-License-Identifier: GPL-2.0-or-later -->", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1-only"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"),
    ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("SPDX-License-Identifier: 0BSD", "0BSD"),
    ("SPDX-License-Identifier: Unlicense", "Unlicense"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0; MIT"),
    ("Copyright (c) 2020 Acme. All rights reserved.", "LicenseRef-all-rights-reserved"),
    ("Copyright 2020 Acme\nLicensed under the MIT License", "MIT"),
    ("Copyright (C) 2020 Acme", ""),
    ("This licence agreement is between you and Acme.", ""),
    ("He was licensed under the new rules to sell fish.", ""),
    ("The warranty of the car had ended.  Nobody was liable.", ""),
]


def test_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan(docs).collect()}
    wrong = [(NOTICES[i][0][:60], got[i], want) for i, (_, want) in enumerate(NOTICES) if got[i] != want]
    assert not wrong and len(NOTICES) >= 60


@pytest.mark.parametrize("copies", [1, 2])
def test_notices_in_sql(spark, copies):
    import duckdb
    import pandas as pd

    rows = [(i, "Words before.\n" * (copies - 1) + t) for i, (t, _) in enumerate(NOTICES)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.execute(license_scan.oracle()).df()
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).astype(str).equals(want[list(got.columns)].sort_values("doc_id").reset_index(drop=True).astype(str))


def test_no_sentence_has_two_meanings():
    assert len(dict(license_scan.RULES)) == len(license_scan.RULES)
    names = [n for names in license_scan.NAMES.values() for n in names]
    assert len(set(names)) == len(names)
