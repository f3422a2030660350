WITH docs AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), numbered AS (
    SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS place,
        max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size
    FROM docs
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM numbered
