"""The twelve jobs from text folder to text folder."""

import pytest

from tallyfold.plans import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


HOUSES = """Address,City,State,Zipcode,Price
7 Quay,Varn,ZZ,88401,310
8 Quay,Varn,ZZ,88401,421.5
1 Mews,Tolm,QX,00917,64
Address of nobody,Tolm,QX,00917,1
2 Mews,Tolm,QX,00917
3 Mews,Tolm,QX,00917,cheap
4 Mews,Tolm,QX,00917,96,extra"""


def test_avg_price(spark, folder, out, lines):
    result = jobs.avg_price(spark, folder(a=HOUSES), out)
    assert rows(result) == [("00917", 80.0), ("88401", 365.75)]
    assert lines(out) == ["00917\t80.0", "88401\t365.75"]


def test_avg_price_with_plain_header_keeps_rows_that_hold_the_marker(spark, folder):
    result = jobs.avg_price(spark, folder(a=HOUSES, b=HOUSES), marker=None)
    assert rows(result) == [("00917", (64 + 1 + 96) / 3), ("88401", 365.75)]


TRANSFERS = "Bank Year Amount\nPluto 1951 77\nMint 1948 12\nPluto 1960 8\nZinc 1955 640\nMint 1949 31"


def test_bank_transfers(spark, folder, out, lines):
    result = jobs.bank_transfers(spark, folder(a=TRANSFERS), out)
    assert rows(result) == [("Mint", 2, 43), ("Pluto", 2, 85), ("Zinc", 1, 640)]
    assert lines(out) == ["Mint\t2 43", "Pluto\t2 85", "Zinc\t1 640"]


def test_bank_transfers_skips_a_missing_amount_and_fails_on_a_bad_one(spark, folder):
    assert rows(jobs.bank_transfers(spark, folder(a="Mint 1951 5\nMint 1952\n"))) == [("Mint", 1, 5)]
    with pytest.raises(Exception, match="bad amount"):
        jobs.bank_transfers(spark, folder(a="Mint 1951 5\nMint 1952 much\n")).collect()


def test_sums_go_past_32_bits(spark, folder):
    text = "Mint 1951 2147483647\n" * 3
    assert rows(jobs.bank_transfers(spark, folder(a=text))) == [("Mint", 3, 3 * 2147483647)]


def test_max_temp(spark, folder, out, lines):
    text = "City, Temperature\nVarn, 2\nTolm, 14\nKesh, 27\nUlm, -6\nUlm, -11\nTolm, 29\nUlm, 1.5"
    path = folder(a=text)
    assert rows(jobs.max_temp(spark, path, out)) == [("Kesh", 27), ("Tolm", 29), ("Ulm", -6), ("Varn", 2)]
    assert lines(out) == ["Kesh\t27", "Tolm\t29", "Ulm\t-6", "Varn\t2"]
    assert ("Ulm", 0) in rows(jobs.max_temp(spark, path, floor=0))


MEDALS = '''id,name,nationality,sex,date_of_birth,height,weight,sport,gold,silver,bronze
1,"Doe, Jo",GRE,female,,,,judo,1,0,2
2,Max Poe,USA,male,,,,judo,0,0,0
3,"Doe, Jo",GRE,female,,,,judo,2,1,0'''


def test_medals(spark, folder, out, lines):
    result = jobs.medals(spark, folder(a=MEDALS), out)
    want = [('"Doe, Jo"', "female", "GRE", "judo", 3, 1, 2), ("Max Poe", "male", "USA", "judo", 0, 0, 0)]
    assert rows(result) == want
    assert lines(out) == ['"Doe, Jo",female,,GRE,judo,3,1,2', "Max Poe,male,,USA,judo,0,0,0"]


def test_medals_with_plain_header_strips_quotes(spark, folder):
    assert rows(jobs.medals(spark, folder(a=MEDALS), marker=None))[0][0] == "Doe, Jo"


def test_medals_fails_on_a_bad_count(spark, folder):
    with pytest.raises(Exception, match="bad silver"):
        jobs.medals(spark, folder(a="1,a,b,c,,,,judo,1,x,2")).collect()


def test_norm_grades(spark, folder, out, lines):
    path = folder(a="Name,Grade\nAnn,10\nBob,1\nCyd,4\nAnn,7\n")
    assert rows(jobs.norm_grades(spark, path, out)) == [("Ann", 6 / 9), ("Ann", 1.0), ("Bob", 0.0), ("Cyd", 3 / 9)]
    assert lines(out)[0] == f"Ann\t{6 / 9}"
    first = jobs.norm_grades(spark, path, one_per_key=True, order_by="grade")
    assert rows(first) == [("Ann", 6 / 9), ("Bob", 0.0), ("Cyd", 3 / 9)]


TREES = "district_name,age_of_tree\nmoor,41\nfen,88\nheath,63\nmoor,52\ndell,88"


def test_oldest_tree(spark, folder, out, lines):
    path = folder(a=TREES)
    assert rows(jobs.oldest_tree(spark, path, out)) == [("dell", 88)]
    assert lines(out) == ["dell\t88"]
    per_district = jobs.oldest_tree(spark, path, per_district=True)
    assert rows(per_district) == [("dell", 88), ("fen", 88), ("heath", 63), ("moor", 52)]
    assert rows(jobs.oldest_tree(spark, folder(a="district_name,age_of_tree"))) == []


def test_patient_filter(spark, folder, out, lines):
    text = "ID, PatientCycleNum, Counseling\n7001, 1, No\n7050, 41, Yes\n88, 1, Yes\n89, 1, Maybe\n7099, 6, No\n90, 5, "
    result = jobs.patient_filter(spark, folder(a=text), out)
    assert rows(result) == [("7050", 41, "Yes"), ("7099", 6, "No"), ("88", 1, "Yes")]
    assert lines(out) == ["88\t1 Yes", "7099\t6 No", "7050\t41 Yes"]


def test_score_comp(spark, folder, out, lines):
    text = "Character Num\nK -9.0\nK 3.0\nK -7.0\nM -2.0\nM 13.0\nM -2.0\nΩ -4.0\nΩ 4.0\nΩ -4.0\nP 1.0"
    path = folder(a=text)
    scores = {"K": 3 / 16, "M": 3.25, "Ω": 0.5}
    assert dict(rows(jobs.score_comp(spark, path, out))) == scores | {"P": None}
    assert [line.split("\t")[0] for line in lines(out)] == ["K", "M", "P", "Ω"]
    assert dict(rows(jobs.score_comp(spark, path, on_zero="ieee"))) == scores | {"P": float("-inf")}


def test_sym_diff(spark, folder, out, lines):
    path = folder(a="q20 5\nq77 6\nq41 7\nq41 8", b="3 q90\n2 q52\n1 q20")
    assert rows(jobs.sym_diff(spark, path, out)) == [("q41",), ("q52",), ("q77",), ("q90",)]
    assert lines(out) == ["q41\t", "q52\t", "q77\t", "q90\t"]
    for bad in ("12", "12 ", "q20 1\n  "):
        with pytest.raises(Exception, match="no id in line"):
            jobs.sym_diff(spark, folder(a=bad)).collect()


def test_read_folder_files(spark, folder, out, lines):
    path = folder(a="x yy\n77\nz9", b=b"caf\xc3\xa9 \xff\n", c="")
    want = {"a.txt": "x yy --- 77 --- z9", "b.txt": "café � --- ", "c.txt": ""}
    assert dict(rows(jobs.read_folder_files(spark, path, out))) == want
    assert lines(out) == [f"{name}\t{content}" for name, content in want.items()]


BOOK = {
    "one": "It's late; it is LATE.\n\n2024\nLate again",
    "two": "it is a cat2cat day",
}


def test_max_tf_words(spark, folder, out, lines):
    # one: it s late it is late late again -> 8 words, 5 distinct.  two: it is a catcat day -> 5, 5.
    result = {r.word: (r.docs, r.file_name, r.tf) for r in jobs.max_tf_words(spark, folder(**BOOK), out).collect()}
    assert result == {
        "it": (2, "one.txt", 0.4), "s": (1, "one.txt", 0.2), "late": (1, "one.txt", 0.6),
        "is": (2, "one.txt", 0.2), "again": (1, "one.txt", 0.2),
        "a": (1, "two.txt", 0.2), "catcat": (1, "two.txt", 0.2), "day": (1, "two.txt", 0.2),
    }
    assert lines(out)[0] == "a\t1, two.txt"
    total = {r.word: (r.file_name, r.tf) for r in jobs.max_tf_words(spark, folder(**BOOK), norm="total").collect()}
    assert total["it"] == ("one.txt", 0.25) and total["is"] == ("two.txt", 0.2)


def test_top_words(spark, folder, out, lines):
    path = folder(**BOOK)
    top = jobs.top_words(spark, path, out, n=3)
    assert [tuple(r) for r in top.collect()] == [(2, "is"), (3, "late"), (3, "it")]
    assert lines(out) == ["2\tis", "3\tlate", "3\tit"]
    distinct = jobs.top_words(spark, path, n=3, distinct_counts=True)
    assert [tuple(r) for r in distinct.collect()] == [(1, "s"), (2, "is"), (3, "late")]
    blank = jobs.top_words(spark, path, n=9, keep_blank=True)
    assert (2, "") in [tuple(r) for r in blank.collect()]


def test_results_replace_older_results(spark, folder, out, lines):
    jobs.max_temp(spark, folder(a="X, 1\nY, 2"), out)
    jobs.max_temp(spark, folder(a="Z, 3"), out)
    assert lines(out) == ["Z\t3"]


def test_partition_folders_are_text(spark, tmp_path):
    for name, text in (("01", "a a b"), ("1", "a c")):
        (tmp_path / f"doc={name}").mkdir()
        (tmp_path / f"doc={name}" / "x.txt").write_text(text)
    got = {r.word: (r.docs, r.doc) for r in jobs.max_tf_words(spark, str(tmp_path), doc="doc").collect()}
    assert got == {"a": (2, "01"), "b": (1, "01"), "c": (1, "1")}
