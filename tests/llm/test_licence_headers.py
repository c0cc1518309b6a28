"""Licences in source headers: comment marks, copyright lines, holders and SPDX names."""

from loomgraph.llm import licenses


def test_headers(spark):
    s = licenses.SENTENCES
    mit = [s["mit-grant"] + ":", "", s["mit-notice"] + ".", "", s["mit-as-is"] + ". " + s["mit-liability"] + "."]
    bsd = [s["bsd-use"] + ":", s["bsd-source"] + ".", s["bsd-binary"] + "."]
    named = s["bsd-endorse"].replace("the copyright holder", "Foo, Inc.")
    rows = [
        (1, "\n".join(f"// {x}".rstrip() for x in ["Copyright (c) 2020 Foo", "", *mit])),
        (2, f"Copyright 2020 Foo\n{s['isc-grant']}."), (3, "\n".join(["Copyright (c) 2020 Foo", *bsd, named + "."])),
        (4, "/*\n * " + "\n * ".join(["(c) 2020 Foo", *bsd, named.replace(" of ", " of\n * ") + "."]) + "\n */"), (5, "\n".join(bsd)),
        (6, s["mit-grant"] + ":\n\nThe above\ncopyright notice and" + s["mit-notice"].split("notice and", 1)[1] + ".\n" + mit[-1]),
    ]
    names = {"GPL-2.0-only": "GPL-2.0", "BSD-2-Clause": "BSD-2-Clause", "ISC": "ISC", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "CC-BY-4.0": "CC-BY-4.0"}
    rows += [(10 + n, f"# SPDX-License-Identifier: {name}\nimport os") for n, name in enumerate(names)]
    got = sorted((r.doc_id, r.license, r.n_sentences) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [
        (1, "MIT", 4), (2, "ISC", 1), (3, "BSD-2-Clause", 3), (3, "BSD-3-Clause", 4), (4, "BSD-2-Clause", 3), (4, "BSD-3-Clause", 4), (5, "BSD-2-Clause", 3),
        (6, "MIT", 4), *((10 + n, licence, 2) for n, licence in enumerate(names.values())),
    ]
