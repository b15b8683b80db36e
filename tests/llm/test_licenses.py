import re

import pytest

from docstrata.llm.licenses import LICENSE_WORD, PHRASES, scan_licenses

TEMPLATES = [("one", "alpha beta gamma delta epsilon"), ("two", "beta zeta"), ("cc-by", "Licensed under CC BY")]


def brute(text, templates, threshold=0.8):
    """Every window of a template's length, the last ones shorter; those that start with a word of the template count."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(LICENSE_WORD, low)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {label for _, label in places}, 0.0
    for label, t, *more in templates:
        t = re.findall(LICENSE_WORD, t.lower())
        must, never = (set(m.split()) for m in more or ("", ""))
        for s in range(len(words)):
            own = set(words[s : s + len(t)])
            share = len(set(t) & own) / len(set(t))
            if words[s] in t and share >= threshold and must <= own and not never & own:
                labels.add(label)
                best = max(best, share)
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in places})), ",".join(sorted(labels)), 1.0 if at else best)


TEXTS = [
    None, "", " \n\n", "CC-BY", "cc by cc by CC  BY", "All rights\nreserved. all RIGHTS reserved", "General Public License", "alpha beta gamma delta x",
    "epsilon delta gamma beta", "alpha beta gamma\ndelta epsilon", "beta zeta", "Beta, ZETA beta", "licensed by cc under", "ccby xcc by", "é cc by é", "alpha " * 50_000 + "beta gamma delta cc by",
    "x y\nalpha beta\n\ngamma\ndelta", "x alpha\nbeta gamma\nfar y\ndelta epsilon", "beta\n" * 3000 + "zeta",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin it", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License",
    "Copyright (c) 2020 A. Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated\ndocumentation files (the", "Copyright B. Redistribution and use in source and binary\nforms, with or without modification,\nare permitted",
    "released " + "filler " * 2000 + "under " + "filler " * 2000 + "the mit " + "filler " * 2000 + "license", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-SA 4.0.", "licensed under\nCC BY 4.0", "It is licensed under CC BY-NC-SA 4.0", "licensed under the GNU Lesser General Public License, version 3",
    "beta alpha\n" * 2000 + "gamma",
]


@pytest.mark.parametrize("templates", [TEMPLATES, [], None])
def test_against_brute_force(make_docs, templates):
    from docstrata.llm import licenses

    texts = TEXTS + ["beta zeta"] * 30
    got = scan_licenses(make_docs(list(enumerate(texts)) + [(0, None)]), templates).collect()
    want = sorted([(i, *brute(t, licenses.TEMPLATES if templates is None else templates)) for i, t in enumerate(texts)] + [(0, *brute(None, []))], key=str)
    assert sorted([tuple(r)[:8] for r in got], key=str) == want


def test_statements_get_their_own_labels(make_docs):
    got = {r.doc_id: r for r in scan_licenses(make_docs(list(enumerate(TEXTS)))).collect()}
    at = next(i for i, t in enumerate(TEXTS) if t and t.startswith("Permission"))
    assert [got[at + i].labels for i in range(11)] == ["mit", "bsd", "gpl,gpl-2.0", "mit", "bsd", "", "cc-by,cc-by-nc-4.0", "cc-by,cc-by-sa-4.0", "cc-by,cc-by-4.0", "cc-by,cc-by-nc-sa-4.0", "gpl,lgpl"]
    assert got[at].blocks[0].word == 0 and got[at + 3].blocks[0].word > 0 and got[at + 5].score == 0


def test_against_the_sql(make_docs):
    import duckdb

    from docstrata.llm import licenses

    rows = [(i, t) for i, t in enumerate(TEXTS) if len(t or "") < 2000]  # DuckDB copies a text's words for each of them
    documents = make_docs(rows, extra=False).toPandas()  # noqa: F841  DuckDB reads it by name
    for templates in (licenses.TEMPLATES, TEMPLATES):
        want = duckdb.sql(licenses.oracle(templates)).fetchall()
        got = scan_licenses(make_docs(rows), templates).collect()
        assert sorted(tuple(r)[:8] for r in got) == sorted(want)


def test_empty_table_and_null_id(make_docs):
    docs = make_docs([(None, "cc by")])
    assert scan_licenses(docs).first().base_labels == "cc-by"
    assert scan_licenses(docs.limit(0)).collect() == []
