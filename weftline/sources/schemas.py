"""Schemas of the nested result documents, of the tables derived from them, and the sentinels for what is missing."""

RESULT = """Sequences array<struct<Id:string,Version:string,Description:string,Length:bigint,
 Cas:array<struct<Type:string,Start:bigint,End:bigint,Genes:array<string>>>,
 Crisprs:array<struct<Name:string,Start:bigint,End:bigint,Evidence_Level:int,Repeat_ID:string,DR_Consensus:string,DR_Length:int,Spacers:int,
  Potential_Orientation:string,CRISPRDirection:string,Conservation_DRs:double,Conservation_Spacers:double,
  Regions:array<struct<Type:string,Sequence:string>>>>>>"""

EXAMPLE = """array_name string, genome_id string, genome_version string, group_name string, agreement string, evor_direction string, crispr_direction string,
 potential_orientation string, evidence_level int, source_json string, sequence_id string, sequence_version string, sequence_description string,
 sequence_length bigint, array_start bigint, array_end bigint, array_length bigint, dr_consensus string, dr_length int, repeat_id string, n_spacers int,
 cas_subtype string, spacers array<string>, repeats array<string>, label int, orientation_variant string, source_variant string, left_flank string, right_flank string"""

METADATA = "map<string,struct<repeat:string,direction:string>>"
CLUSTERS = "map<string,struct<size:int,arrays:map<string,struct<was_flipped:boolean,cas_type:string>>>>"

SINGLETON = "singleton"
UNKNOWN_REPEAT = "UNKNOWN"
