import duckdb
import pytest

from docloom.llm.licenses import oracle, scan_licenses

GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """BSD 2-Clause License

Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """ISC License

Copyright 2019 by A. Person <a@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.
"""
HEADERS = [
    (MIT, "MIT:text"), (MIT.replace("\n\nCopyright", "\nCopyright").replace("Person\n\n", "Person\n"), "MIT:text"), (MIT.replace("\n", "\r\n"), "MIT:text"),
    (BSD2 + END, "BSD-2-Clause:text"), (BSD2 + BSD3 + END, "BSD-3-Clause:text"), (ISC, "ISC:text"), ("Copyright 2020 A. Person\n" + APACHE, "Apache-2.0:text"), (BSD2.replace("1.", "*").replace("2.", "*"), "BSD-2-Clause:text"),
    (GPL.format(a=":", b=",", v=3), "GPL-3.0-or-later:text"), (GPL.format(a=";", b=";", v=2), "GPL-2.0-or-later:text"), (GPL.format(a=";", b=",", v=2), "GPL-2.0-or-later:text"),
    (MPL, "MPL-2.0:text"), (APACHE, "Apache-2.0:text"),
]


@pytest.mark.parametrize("comment", ["", "# ", " * "])
def test_official_headers(spark, comment):
    rows = [(i, "".join(f"{comment}{line}" for line in t.splitlines(keepends=True))) for i, (t, _) in enumerate(HEADERS)]
    got = dict(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "licenses").collect())
    assert got == {i: name for i, (_, name) in enumerate(HEADERS)}


def test_oracle_agrees_on_whole_files(spark):
    rows = [(i, t) for i, (t, _) in enumerate(HEADERS)] + [(100, None), (101, ""), (102, HEADERS[0][0] + "\nprose.\n\n" + HEADERS[3][0] + HEADERS[4][0]), (103, "Released under the MIT License."), (103, "x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    ours = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sentence_ids", "n_sentences", "licenses").collect()
    assert sorted(map(tuple, ours)) == sorted(con.execute(oracle()).fetchall())
    assert {r.licenses for r in ours if r.doc_id == 102} == {"BSD-3-Clause:text,MIT:text"}
