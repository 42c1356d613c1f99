"""Explicit schemas of what the engine reads and writes."""

from __future__ import annotations

PATTERNS5 = "struct<urls:array<string>,phones:array<string>,dates:array<string>,times:array<string>,amounts:array<string>>"
BOX = "struct<x:double,y:double,width:double,height:double>"
VARIANT = f"struct<text_path:string,patterns:{PATTERNS5},score:double,text_length:int,status:string,error:string>"
CELL = f"struct<row:int,col:int,bbox:array<int>,text:string,patterns:{PATTERNS5},ocr_variant:string>"
CELLS = (
    "struct<method:string,row_count:int,col_count:int,rows:array<array<string>>,line_detection:struct<h_lines:int,v_lines:int,selected_params:map<string,double>>,"
    f"structure_hint:string,grid_candidates:array<struct<grid:array<int>,score:double,pattern_count:int>>,selected_grid_reason:string,cells:array<{CELL}>,warnings:array<string>>"
)
TABLE = (
    "struct<table_id:string,bbox:array<int>,area:long,relative_area:double,aspect_ratio:double,text_density_estimate:double,is_too_small:boolean,is_too_large:boolean,"
    "is_header_like:boolean,is_low_text_density:boolean,candidate_priority_score:double,is_candidate:boolean,filter_reason:string,image_path:string,zoom2x_path:string,"
    f"zoom3x_path:string,ocr_text_path:string,zoom2x_ocr_text_path:string,zoom3x_ocr_text_path:string,ocr_variants:map<string,{VARIANT}>,best_table_ocr_variant:string,"
    f"patterns:{PATTERNS5},table_priority_score:double,cell_structure:{CELLS}>"
)
SUMMARY = (
    "struct<detected_count:int,candidate_count:int,best_table_id:string,best_table_reason:string,found_urls:array<string>,found_phones:array<string>,found_dates:array<string>,"
    "found_times:array<string>,found_amounts:array<string>,warnings:array<string>>"
)
#: One result document of an OCR experiment, as DDL: parsing it here would need a running session.
RESULT = (
    "schema_version string, created_at string, input struct<path:string,file_name:string>, experiment_dir string, ocr_engine struct<name:string,lang:string>,"
    "ocr_results array<struct<name:string,status:string,debug_image_path:string,text_path:string,text_length:int,error:string>>,"
    f"tables array<{TABLE}>, table_summary {SUMMARY}, warnings array<string>, cautions array<string>, todo array<string>"
)
