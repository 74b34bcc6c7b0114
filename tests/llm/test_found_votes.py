from pyspark.sql import functions as F

from strandline.llm import queries as Q
from strandline.llm.quality import NOT_PROSE


def test_found_is_the_posterior(spark, data):
    """The documents found are those whose posterior of prose is 0, which are those with a stated threshold's vote."""
    types = Q._types(spark, data)
    found = {r.doc_id for r in Q.p8_found(spark, data).collect()}
    assert found == {r.doc_id for r in types.filter("p_prose = 0").select("document.doc_id").collect()}
    assert found == {r.doc_id for r in types.filter(F.greatest(*(F.col(f"v_{n}") for n in NOT_PROSE))).select("document.doc_id").collect()}
    assert types.filter("text_type <> 'prose'").count() > 0 and types.filter("p_prose > 0 and p_prose < 1e-15").count() == 0
