from factloom.llm.truncation import Limits, cut_share, cut_texts, length_limits

SCHEMA = "doc_id long, text string, source string, form string, line string"


def corpus():
    rows, want = [], {}

    def add(text, source, cut):
        want[len(rows)] = cut
        rows.append((len(rows), text, source, "x", "y"))

    body = "The board approved the accounts for the year and no adverse remark was made. "
    for n in range(30):
        whole = f"Notice {n}. " + body * (1 + n % 4)
        add(whole.strip(), "feed" if n % 2 else "desk", False)
        add((f"Limit {n:03d} " + body * 5)[:200], "sms", True)
        add((f"Bytes {n:03d} " + "é" * (n % 3) + " Größe äöü" + body * 5).encode()[:230].decode(errors="ignore"), "api", True)
        add(whole + "\n\nFor the Board\nCompany Secretary", "feed" if n % 2 else "desk", False)
        add(whole + f"\n\nRow | {n} | {n + 1}", "feed" if n % 2 else "desk", False)
    add(body + "The board deferred the pro", "feed", True)
    add(body + "The board deferred… Read more", "desk", True)
    add(body + "The board [...]", None, True)
    add(body + "\n\nThe boa", "feed", True)
    add((f"x Limit at a short form {body}" + "y" * 300)[: 200 - 5] + " Ltd.", "sms", True)
    add("निदेशक मंडल ने स्वीकृत किया।", "feed", False)
    add("निदेशक मंडल ने स्वी", "feed", True)
    for blank in (None, "", "  \n\t "):
        add(blank, "feed", False)
    add("long words " * 200_000 + "end.", "feed", False)
    # no running text where it stops: only its length says that it was cut
    add((body * 4)[: 200 - 20] + "\n\nSignedbytheChairman", "sms", True)
    add((body * 4)[: 190 - 20] + "\n\nSignedbytheChairman", "sms", False)
    return rows, want


def test_cut_texts_and_limits(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.is_cut for r in cut_texts(df, "doc_id", "text", "source").collect()}
    assert {k for k in want if got[k] != want[k]} == set()
    limits = {(r.source, r.unit): r.limit for r in length_limits(df, ["text", "form"], "source").where("source in ('sms', 'api')").collect()}
    assert limits[("sms", "chars")] == 200 and limits[("api", "bytes")] == 230
    share = {r.source: r for r in cut_share(cut_texts(df, "doc_id", "text", "source")).collect()}
    assert share["sms"].n_cut == share["sms"].n_limit == 32 and share["sms"].n_docs == 33 and share["(none)"].n_cut == 1


def test_the_histograms_decide_what_a_limit_cut(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = lambda p: {r.doc_id for r in cut_texts(df, "doc_id", "text", "source", p).where("is_cut").collect()}
    without = found(Limits(least=10_000))  # no length is a limit
    lost = found(Limits()) - without
    assert lost and {rows[k][2] for k in lost} == {"sms"} and without - found(Limits()) == set()
    assert cut_texts(df, "doc_id", "text", "source").where("limit_cut and transfer_cut").count() == 0


def test_copies_of_one_text_are_no_limit(spark):
    df = spark.createDataFrame([(n, "The same notice under new ids, whole as it is.", "feed", "", "") for n in range(50)], SCHEMA)
    assert length_limits(df, ["text"], "source").collect() == []
    assert cut_texts(df.limit(0), "doc_id", "text", "source").collect() == []
