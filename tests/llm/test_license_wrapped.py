from netloom.llm import licenses as lic

GPL = [
    "# This program is free software: you can redistribute it and/or modify",
    "# it under the terms of the GNU General Public License.",
]


def test_wrapped_notices(docs_of, spark):
    model = lic.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    plain = "the quick story of a house in the old town by the river"
    rows = [(1, "\n".join(GPL)), (2, "\n".join([plain, "#", *GPL, "#", plain])), (3, f"{plain}\nReleased under the MIT License.\n{plain}")]
    rows += [(4, "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this\nsoftware and associated\ndocumentation files")]
    got = lic.scan(docs_of(rows), model).where("confirmed").collect()
    want = [(1, 0, "gpl-3.0"), (2, 2, "gpl-3.0"), (3, 1, "mit"), (4, 0, "mit")]
    assert sorted((r.doc_id, r.place, r.family) for r in got) == want


def test_copies_leave_the_draw_to_others(docs_of):
    rows = [(k, "one text that many rows hold") for k in range(200)] + [(1000 + k, f"another text number {k}") for k in range(20)]
    got = lic.training_rows(docs_of(rows), drawn=15).where("family = 'unknown' AND words[1] = 'text' AND size(words) <= 6").collect()
    assert len(got) == 15
