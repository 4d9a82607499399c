from oracle import same

from fathom.llm import licenses


def test_against_sql(spark, tmp_path):
    docs = [
        (1, licenses.MIT), (2, "THE MIT LICENCE (MIT)\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.upper()), (3, "Some code.\nReleased under the MIT licence!\nMore"), (4, licenses.MIT[:-5]),
        (5, "intro\n\n" + licenses.ISC.split("\n\n")[0] + "\n\n" + licenses.APACHE_NOTICE), (6, None), (7, ""), (8, "...\n\n!!"), (9, "(c) me\nAll rights  reserved"), (9, "(c) me\nAll rights  reserved"),
        (None, "all RIGHTS reserved."), (10, "x " * 9000 + "\nLicensed under CC BY-NC 4.0."), (11, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (12, "© 2020\n" + licenses.GPL3_NOTICE),
    ]
    spark.createDataFrame([(*d, "u", "w") for d in docs], "doc_id long, text string, unit string, whole string").write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), "op10_license_digests")
    got = {r.doc_id: (r.licenses, r.whole) for r in licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    assert got[1] == got[2] == ("MIT", True)
    assert got[3] == ("MIT", False) and got[4] == ("", False) and got[6] == ("", False)
    assert got[12] == ("GPL-3.0-or-later", True) and got[9] == ("LicenseRef-All-Rights-Reserved", True)
    assert got[11] == ("CC-BY-NC-4.0,MIT", False)


def test_given_and_empty(spark):
    same(spark, "/root/testdata/sf0.001", "op10_license_digests")
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_texts(spark):
    from pathlib import Path

    import pytest

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause"}
    there = {f: n for f, n in names.items() if (folder / f).exists()}
    if not there:
        pytest.skip("no texts of licences here")
    docs = []
    for k, f in enumerate(there):
        text = (folder / f).read_text()
        docs += [(3 * k, text), (3 * k + 1, "Copyright (c) 2024 Us\n" + " ".join(text.replace("https", "http").upper().split(" "))), (3 * k + 2, text.replace("the", "a", 1) + " more")]
    docs += [(900, "BSD 3-Clause Licence\n\nCopyright 2020 Someone\n\n" + (licenses.BSD_2 + licenses.BSD_3 + licenses.BSD_END).replace("copyright holder", "copyright owner")), (901, licenses.BSD_2 + licenses.BSD_END)]
    got = {r.doc_id: (r.licenses, r.whole) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, n in enumerate(there.values()):
        assert all(n in got[i][0].split(",") and got[i][1] for i in (3 * k, 3 * k + 1))  # BSD has a line "All rights reserved." as well
        assert not got[3 * k + 2][1]
    assert got[900] == ("BSD-3-Clause", True) and got[901] == ("BSD-2-Clause", True)
