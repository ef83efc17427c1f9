"""Which seeds, candidates and contexts bootstrapping uses, and what redaction covers."""

from ledgerloom.llm import pii


def spans(spark, rows):
    return {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_whole_base_spans_seed_patterns(spark):
    """Phones, cards and addresses of several digit groups teach contexts, and a run of groups is found whole."""
    rows = [(k, f"w{k} please phone him +1 (017) 555-77{k:02} now") for k in range(20)]
    rows += [(100 + k, f"w{k} the server host 10.0.0.{k} again") for k in range(20)]
    rows += [(200, "x please phone him (017) 555 9913 now"), (201, "y the server host 10.0.0.300 again"), (202, "z some other thing (017) 555 9914 now")]
    got = spans(spark, rows)
    assert got[200] == f"phone:{rows[40][1].index('(017')}:{rows[40][1].index(' now')}"
    assert got[201] == f"ip:{rows[41][1].index('10.')}:{rows[41][1].index(' again')}"
    assert got[202] == ""


def test_cards_in_groups_seed_patterns(spark):
    def card(k):
        head = f"41111111111{k:04}"
        check = next(c for c in range(10) if sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(head + str(c))))) % 10 == 0)
        n = head + str(check)
        return " ".join(n[i : i + 4] for i in range(0, 16, 4))

    rows = [(k, f"w{k} paid with card {card(k)} today") for k in range(12)]
    rows += [(50, f"v paid with card 4111 1111 1111 1112 today")]
    assert spans(spark, rows)[50] == f"card:{rows[12][1].index('4111')}:{rows[12][1].index(' today')}"


def test_contexts_reach_over_identifiers_and_accepted_tokens_count_everywhere(spark):
    rows = [(k, f"w{k} pair jo{k}@mail.example.com +1 (017) 555-77{k:02} now") for k in range(20)]
    rows += [(50, "v pair ann@mail.example.com (017) 555 9913 now")]
    rows += [(51, "4845168114407329 q"), (52, "q 7536784127813050 4845168114407329 q"), (53, "(017) 555 9913 at the start")]
    got = spans(spark, rows)
    start = rows[20][1].index("(017")
    assert got[50].split(",")[-1] == f"phone:{start}:{start + 14}"
    assert got[52] == "card:19:35" and got[53] == "phone:0:14"


def test_redaction_covers_overlapping_spans(spark):
    rows = [(1, "call +1 202 555 0100jo@x.com now"), (2, "pay 4111111111111111@host.example now")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "call [PHONE] now", 2: "pay [EMAIL] now"}
