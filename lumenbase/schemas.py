"""The data model as Spark DDL, one name for each entity."""

from __future__ import annotations

LOCATION = "struct<page:int,section:string,item_index:int,style:string,table_number:int,sheet:string,row:int>"
CHUNK_LOCATION = "struct<page:int,section:string,item_index:int,style:string,table_number:int,sheet:string,row:int,row_start:int,row_end:int,day:string,session:string,class_name:string,grade:string,periods:string>"
BLOCKS = f"id string, file_id string, source string, relative_path string, file_type string, block_index int, block_type string, text string, location {LOCATION}"
FILE_MANIFEST = "file_id string, source string, relative_path string, file_type string, content_sha1 string, blocks int, errors array<string>"
CHUNKS = f"id string, file_id string, source string, relative_path string, file_type string, chunk_index int, block_ids array<string>, block_types array<string>, location {CHUNK_LOCATION}, text string, retrieval_text string, char_count int"
CHUNK_VECTORS = "id string, document string, embedding array<float>, file_id string, source string, relative_path string, file_type string, chunk_index int, block_types string, section string, page string, table string, sheet string, row string, char_count int"
LESSONS = "source string, relative_path string, title string, sheet string, class_name string, grade string, day string, session string, period int, value string, source_type string, ambiguity string"
QUESTION = "struct<class_name:string,grade:string,days:array<string>,sessions:array<string>,periods:array<int>,mode:string,explicit_fields:array<string>>"
CELLS = "source string, relative_path string, sheet string, row int, col int, value string"
MERGED_RANGES = "source string, sheet string, min_row int, min_col int, max_row int, max_col int"
MESSAGES = "session_id string, pos int, role string, content string"
CATALOGUE = "id string, name string, relative_path string, type string, download_url string, size_bytes long, source_group string"
