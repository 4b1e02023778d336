

from quernstone.plans import (  # noqa: F401  (each registers its queries)
    evidence_queries,
    import_queries,
    record_queries,
    relation_queries,
    retrieval_queries,
    run_queries,
    search_queries,
    store_queries,
    text_queries,
)
