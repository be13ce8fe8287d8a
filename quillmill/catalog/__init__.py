"""All registered queries of the library's own operators."""

from quillmill.catalog import analysis_queries, catalogue_queries, grounding_queries, job_queries, layout_queries, lookup_queries, number_queries, plan_queries, source_queries, stream_queries, text_queries  # noqa: F401
