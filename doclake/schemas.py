"""Declared schemas of all tables and of what model tasks return."""

PAGES = "source string, page int, text string"
SUMMARY = "struct<executive_summary:string,key_topics:array<string>,key_takeaways:array<string>,important_entities:array<string>>"
COMPARISON = "struct<matching_points:array<string>,missing_in_a:array<string>,missing_in_b:array<string>,recommendations:array<string>,overall_match_percent:double>"
NOTES = (
    "struct<summary:string,key_concepts:array<struct<concept:string,explanation:string>>,flashcards:array<struct<front:string,back:string>>,"
    "viva_questions:array<struct<question:string,answer:string>>,mcqs:array<struct<question:string,options:array<string>,correct:string>>>"
)
CROSS = "array<struct<concept:string,found_in:array<string>,relevance:string>>"
DOCUMENT = f"struct<doc_id:string,filename:string,file_path:string,full_text:string,chunk_count:int,summary:{SUMMARY},uploaded_at:timestamp>"
COLLECTION = "struct<collection_id:string,name:string,doc_ids:array<string>,created_at:timestamp>"
HISTORY = "id string, timestamp timestamp, question string, answer string, context array<struct<content:string,source:string,confidence_percent:double,page:int>>"
