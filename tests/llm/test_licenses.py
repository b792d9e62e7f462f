import textwrap

import duckdb
import pandas as pd
from conftest import SF_DIR
from plain import ODD, odd_documents, result

from hostweave.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the software, and to permit persons to whom the software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. And more text."""
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""
HOLDER = ENDORSE.replace("the copyright holder", "Example Corp.")
CANONICAL = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + "3. " + HOLDER, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "Apache-2.0": APACHE, "ISC": ISC}


def wrapped(text, width, prefix=""):
    return "\n\n".join("\n".join(textwrap.wrap(p, width, initial_indent=prefix, subsequent_indent=prefix)) for p in text.split("\n\n"))


WRAPPED = [(200 + 10 * i + k, "Some code\n\n" + wrapped(text, width, prefix), "en", "a") for i, text in enumerate(CANONICAL.values()) for k, (width, prefix) in enumerate([(40, ""), (61, ""), (72, " * "), (79, "# "), (400, "")])]
TEXTS = ODD + WRAPPED + [
    (108, "This project is licensed under the Apache License\nVersion 2.0. Released under the MIT License\nNext line of text.", "en", "a"),
    (109, "Words end. released under the mit license. and go on", "en", "a"),
    (100, "Some words.\n" + MIT, "en", "a"),
    (101, BSD, "en", "a"),
    (102, BSD + ENDORSE, "en", "a"),
    (103, "Released under the MIT License. Released under the MIT License!\nLicensed under CC BY-NC 4.0.", "en", "a"),
    (104, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "en", "a"),
    (105, "A text without an end\nThis work is licensed under the GNU General Public License, version 3.", "en", "a"),
    (106, "This licence is not known. Neither is this warranty.", "en", "a"),
    (107, ENDORSE, "en", "a"),
]


def test_rules_match_sequences_in_order(spark):
    found = {r.doc_id: r for r in licenses.license_scan(odd_documents(spark, TEXTS)).collect() if r.doc_id}
    assert found[100].licences == "MIT" and found[100].sentence_ids == "MITgrant MITnotice MITasis"
    assert found[101].licences == "BSD-2-Clause"
    assert found[102].licences == "BSD-3-Clause" and found[102].n_unmatched == 0
    assert found[103].licences == "MIT MIT CC-BY-NC-4.0" and found[103].n_sentences == 3
    assert found[104].licences == "Apache-2.0" and found[104].n_sentences == 2
    assert found[105].licences == "GPL-3.0"
    assert found[106].n_sentences == 0
    assert found[107].licences == "" and found[107].n_unmatched == 1
    assert all(found[i].n_sentences == 0 for i in (1, 2, 3, 4, 5, 6, 7, 9))


def test_canonical_texts_at_any_wrap(spark):
    found = {r.doc_id: r for r in licenses.license_scan(odd_documents(spark, WRAPPED)).collect()}
    for i, name in enumerate(CANONICAL):
        for k in range(5):
            assert (found[200 + 10 * i + k].licences, found[200 + 10 * i + k].n_unmatched) == (name, 0), (name, k, found[200 + 10 * i + k])


def test_references_over_lines(spark):
    found = {r.doc_id: r.licences for r in licenses.license_scan(odd_documents(spark, TEXTS)).collect()}
    assert found[108] == "Apache-2.0 MIT" and found[109] == "MIT"


def test_every_known_sentence_has_a_hint():
    import re

    assert all(re.search(licenses.HINT, s) for s in licenses.known_sentences())


def test_the_scan_is_its_sql(spark):
    database = duckdb.connect()
    documents = pd.DataFrame([r[:2] for r in TEXTS], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    database.register("documents", documents)
    assert result(licenses.license_scan(odd_documents(spark, TEXTS))) == sorted(database.sql(licenses.sql()).fetchall(), key=repr)
    assert result(licenses.license_scan(odd_documents(spark, []))) == []


def test_the_scan_is_its_sql_on_the_table(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    found = licenses.license_scan(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert result(found) == sorted(database.sql(licenses.sql()).fetchall(), key=repr)


def test_no_python_in_the_plan(spark):
    plan = licenses.license_scan(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
