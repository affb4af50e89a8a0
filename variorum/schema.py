"""Schemas of the data model, as DDL."""

OPERATION = "struct<type:string,char:string,original_char:string,target_char:string,position:int>"
OPERATIONS = f"array<{OPERATION}>"
COSTED = "struct<type:string,char:string,original_char:string,target_char:string,position:int,relation_type:string,reason:string,custom_cost:double>"

#: The canonical table: one row for each sentence of each version; the ordinals keep the order of the source.
WITNESS = "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string"
PAIR = f"chapter_number int, sentence_number int, original_text_version string, original_text string, modified_text_version string, modified_text string, edit_distance int, operations {OPERATIONS}"
COSTED_PAIR = f"chapter_number int, sentence_number int, original_text_version string, original_text string, modified_text_version string, modified_text string, edit_distance int, operations array<{COSTED}>, custom_edit_distance double"

SENTENCE_NODE = "struct<name:string,type:string,description:string,chapter_number:int,sentence_number:int,text:string,version:string>"
CHAPTER_NODE = f"struct<name:string,type:string,description:string,chapter_number:int,sentence_count:int,children:array<{SENTENCE_NODE}>>"
VERSION_NODE = f"struct<name:string,type:string,description:string,index:int,children:array<{CHAPTER_NODE}>>"
TREE = f"name string, type string, description string, children array<{VERSION_NODE}>"

NODE_ATTRIBUTES = "type string, name string, description string, index int, chapter_number int, sentence_number int, sentence_count int, text string, version string"
FAILURE = f"index long, error string, item struct<chapter_number:int,sentence_number:int,original_text_version:string,original_text:string,modified_text_version:string,modified_text:string,edit_distance:int,operations:{OPERATIONS}>"
