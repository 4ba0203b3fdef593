"""A corpus converted as a whole: repaired texts and judged line breaks are written once, the tables of the result are lazy plans over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import spans, structure, words
from quire.runtime import written
from quire.settings import Conversion


def convert(pages: DataFrame, blocks: DataFrame, outline: DataFrame, lexicon: DataFrame, settings: Conversion = Conversion(), learned: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents, pages, paragraphs, sections, issues, quality and learned words of a corpus.

    Text is repaired at line ends where reading is enabled; spans of pages and sections are in the text as it was, those of
    paragraphs in the repaired one. Words are learned from all documents first, so that their order doesn't matter.
    """
    whole = spans.whole_text(pages)
    placed = spans.page_spans(pages)
    judged = written(words.judge_breaks(written(words.break_candidates(whole), "breaks"), lexicon), "judged")
    texts = written(words.apply_breaks(whole, judged), "texts")
    new = words.learn(judged, lexicon)
    known = new if learned is None else new.unionByName(learned)
    r = settings.reading
    found = words.text_statistics(texts, lexicon, r.mode if r.enabled else "legacy", r.vocabulary, known, r.least_length, r.least_confidence if r.enabled else 0.0)
    quality = words.quality_level(found)
    outlined = structure.outline_candidates(outline, placed)
    headed = structure.heading_candidates(blocks, placed).select(structure.CANDIDATE)
    candidates = structure.cascade(outlined, headed) if settings.headings == "fonts" else outlined
    contents = structure.contents_candidates(pages, placed)
    sections = structure.sections(structure.enrich_titles(candidates, contents), whole)
    issues = structure.validate(sections)
    kind = structure.type_scores(structure.indicators(pages, outline)).select("doc_id", "type") if settings.use_profiles else structure.builder_type(structure.indicators(pages, outline))
    confidence = structure.structure_confidence(sections, issues).withColumnRenamed("confidence", "structure_confidence")
    n = placed.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    documents = texts.join(kind, "doc_id").join(n, "doc_id").join(confidence, "doc_id", "left").withColumn("structure_confidence", F.coalesce("structure_confidence", F.lit(0.0)))
    return {"documents": documents, "pages": placed, "paragraphs": spans.paragraph_spans(texts), "sections": sections, "issues": issues, "quality": quality, "learned": known}
