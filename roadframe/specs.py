"""The two published versions of the map's layers.

Fixed values: layer and column names, lengths, code keys and references are those of the published
layer manuals and must stay as they are.
"""

from __future__ import annotations

from .schema import RoleFilter, Schema, layer

LINE_TYPES = "111 112 113 114 121 122 123 124 211 212 213 214 221 222 223 224 311 312 313 314 321 322 323 324 999"
MARKS = "5321 533 534 5371 5372 5373 5374 5379 5381 5382 5383 5391 5392"

_C23 = "ID:t12! AdminCode:t3! Maker:t20! UpdateDate:t8 Version:t4! Remark:t30 HistType:t5 HistRemark:t30"
_TO_LINK = "LinkID:t12!->A2_LINK Ref_Lane:i!"

V2023 = Schema(
    "2023.07",
    (
        layer("A1_NODE", "P", "node", _C23, "NodeType:t2!* ITSNodeID:t10", {"NodeType": "1 2 3 4 5 6 7 8 9 10 99"}, required=True),
        layer("A2_LINK", "L", "link", _C23, "RoadRank:t1!* RoadType:t1!* RoadNo:t5 LinkType:t2!* LaneNo:i R_LinkID:t12->A2_LINK L_LinkID:t12->A2_LINK~L_LinKID FromNodeID:t12!->A1_NODE ToNodeID:t12!->A1_NODE~ToNodeId SectionID:t12->A3_DRIVEWAYSECTION|A4_SUBSIDIARYSECTION Length:f ITSLinkID:t30", {"RoadRank": "1 2 3 4 5 6 7 8 9", "RoadType": "1 2 3 4 5", "LinkType": "1 2 3 4 5 6 7 8 9 10 11 12 13 14 99"}, required=True),
        layer("A3_DRIVEWAYSECTION", "G", "driveway_section", _C23, "Kind:t1!* RoadType:t1!*", {"Kind": "1 7", "RoadType": "1 2 3 4 5"}),
        layer("A4_SUBSIDIARYSECTION", "G", "subsidiary_section", _C23, "SubType:t1!* Name:t30! Direction:t1!* GasStation:t1!* LpgStation:t1!* EvCharger:t1!* Toilet:t1!*", {"SubType": "1 2 3 4 9", "Direction": "1 2 3", "GasStation": "0 1", "LpgStation": "0 1", "EvCharger": "0 1", "Toilet": "0 1"}),
        layer("A5_PARKINGLOT", "G", "parking_lot", _C23, "Type:t1!* SectionID:t12!->A4_SUBSIDIARYSECTION", {"Type": "1 2 3 4 5 6 7 9"}),
        layer("B1_SAFETYSIGN", "PG", "traffic_sign", _C23, f"Type:t1!* {_TO_LINK} PostID:t12->C6_POSTPOINT", {"Type": "1 2 3 4"}),
        layer("B2_SURFACELINEMARK", "L", "lane_line", _C23, "Type:t3!* Kind:t5!* R_LinkID:t12->A2_LINK~R_linkID L_LinkID:t12->A2_LINK~L_linkID", {"Type": LINE_TYPES, "Kind": "501 5011 502 503 504 505 506 515 525 530 531 535 599"}, required=True),
        layer("B3_SURFACEMARK", "G", "road_marking", _C23, "Type:t1!* Kind:t4!* LinkID:t12->A2_LINK", {"Type": "1 5", "Kind": f"{MARKS} 5431 5432 544 599"}),
        layer("C1_TRAFFICLIGHT", "P", "traffic_light", _C23, f"Type:t2!* {_TO_LINK} PostID:t12->C6_POSTPOINT~postID", {"Type": "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 99"}, aliases=("C1_TRAFFICLIGH",)),
        layer("C2_KILOPOST", "P", "kilopost", _C23, f"Distance:f! Origin:t30 {_TO_LINK}"),
        layer("C3_VEHICLEPROTECTIONSAFETY", "L", "barrier", _C23, "Type:t2!* IsCentral:t1!*~isCentral LowHigh:t1* Ref_ID:t12->C3_VEHICLEPROTECTIONSAFETY", {"Type": "2 3 4 5 6 7 8 99", "IsCentral": "0 1", "LowHigh": "1 2"}, required=True),
        layer("C4_SPEEDBUMP", "G", "speed_bump", _C23, f"Type:t1!* {_TO_LINK}", {"Type": "1 2 3"}),
        layer("C5_HEIGHTBARRIER", "L", "height_barrier", _C23, f"Type:t1!* {_TO_LINK}", {"Type": "1 2 4"}),
        layer("C6_POSTPOINT", "P", "support_post", _C23, "Type:t1!*", {"Type": "1 2"}),
    ),
    (
        RoleFilter("junction_link", "link", ("link_type",), ("1",)),
        RoleFilter("ordinary_link", "link", ("link_type",), ("4", "5", "6")),
        RoleFilter("pocket_link", "link", ("lane_no",), least=90),
        RoleFilter("uturn_marker", "lane_line", ("kind",), ("502",)),
        RoleFilter("junction_node", "node", ("node_type",), ("1",)),
    ),
    (),
    (("A2_LINK", "r_link_id", "l_link_id"), ("A2_LINK", "l_link_id", "r_link_id"), ("C3_VEHICLEPROTECTIONSAFETY", "ref_id", "ref_id")),
)

_C25 = "ID:t13! SurveyDate:t8! Version:t4! Remark:t30 HistType:t3*"
_H25 = {"HistType": "001 002 003 004 005 006 007 008"}
_NODES = "100 101 102 200 201 202 203 300 400 401 402 403 404 405 406 500 501 502 600 999"
_RANKS = "100 200 300 400 500 600 700 999"
_TO_LINKS = "R_LinkID:t13->NT2_LINK{} L_LinkID:t13->NT2_LINK{}"

V2025 = Schema(
    "2025.12",
    (
        layer("NT1_NODE", "P", "node", _C25, "NodeType1:t3!* NodeType2:t3* NodeType3:t3* StartEnd1:t1* StartEnd2:t1* StartEnd3:t1* Pseudo:t1!* GroupID:t13!", _H25 | {"NodeType1": _NODES, "NodeType2": _NODES, "NodeType3": _NODES, "StartEnd1": "1 2", "StartEnd2": "1 2", "StartEnd3": "1 2", "Pseudo": "0 1"}, required=True),
        layer("NT2_LINK", "L", "link", _C25, "RoadRank:t3!* RoadNo:t5 AdminCode:t5! RoadName:t7! M_RoadRank:t3* M_RoadNo:t5 M_RoadName:t7 RoadType:t3!* MaxSpeed:t3! Direction:t1* LinkType:t3!* Turn:t1* " + _TO_LINKS.format("", "~L_LinKID") + " FromNodeID:t13!->NT1_NODE ToNodeID:t13!->NT1_NODE RoadTypeID:t13->RS2_ROADSTRUCTURE|RS3_SUBSIDIARYSECTION", _H25 | {"RoadRank": _RANKS, "M_RoadRank": _RANKS, "RoadType": "100 200 300 400", "Direction": "1 2 3", "LinkType": "100 101 102 103 104 200 201 300", "Turn": "1 2 3"}, required=True),
        layer("RS1_ROADBORDER", "L", "road_border", _C25, "Kerb:t1!* TFCIsland:t1!*~TFCIsLand " + _TO_LINKS.format("", "~L_LinKID") + " PathwayID:t13->PW1_PATHWAY", _H25 | {"Kerb": "0 1", "TFCIsland": "0 1"}, required=True),
        layer("RS2_ROADSTRUCTURE", "G", "road_structure", _C25, "RSType:t3!*", _H25 | {"RSType": "100 101 102 103 200 300"}, aliases=("RS3_ROADSTRUCTURE",)),
        layer("RS3_SUBSIDIARYSECTION", "G", "subsidiary_section", _C25, "SubsType:t3!* GasStation:t1* LPGStation:t1* EVCharger:t1*", _H25 | {"SubsType": "100 101 999", "GasStation": "0 1", "LPGStation": "0 1", "EVCharger": "0 1"}),
        layer("PW1_PATHWAY", "G", "pathway", _C25, "PathType:t3!* TFCIsland:t1!*~TFCIsLand", _H25 | {"PathType": "100 200", "TFCIsland": "0 1"}),
        layer("RM1_LANELINE", "L", "lane_line", _C25, "LineType:t3!* LineKind:t4!* " + _TO_LINKS.format("~R_linkID", "~L_linkID"), _H25 | {"LineType": LINE_TYPES, "LineKind": "501 5011 502 503 504 505 506 525 530 531 535 599"}),
        layer("RM2_ROADMARKING", "G", "road_marking", _C25, "MarkType:t3!* MarkKind:t4!*", _H25 | {"MarkType": "100 200 300 500 999", "MarkKind": f"522 5232 5233 524 529 {MARKS} 5431 5432 999"}),
        layer("RM3_PARKINGLOT", "G", "parking_lot", _C25, "PLType:t3!*", _H25 | {"PLType": "100 101 102 200 201 202 999"}),
        layer("SF1_BARRIER", "L", "barrier", _C25, "BarrType:t3!* " + _TO_LINKS.format("", "~L_LinKID~L_linkID"), _H25 | {"BarrType": "100 101 102 103 200 300 301 999"}),
        layer("SF2_TRAFFICSIGN", "P", "traffic_sign", _C25, "SignType:t3!* PostID:t13->SF4_SUPPORTPOST", _H25 | {"SignType": "100 200 300 400"}),
        layer("SF3_TRAFFICLIGHT", "P", "traffic_light", _C25, "LightType:t3!* PostID:t13->SF4_SUPPORTPOST", _H25 | {"LightType": "100 101 102 103 110 111 112 120 121 130 140 141 200 201 300 400 401 999"}),
        layer("SF4_SUPPORTPOST", "P", "support_post", _C25, "PostType:t3!*", _H25 | {"PostType": "100 200"}, aliases=("SF4_SUPPROTPOST",)),
        layer("SF5_SPEEDBUMP", "G", "speed_bump", _C25, "", _H25),
    ),
    (
        RoleFilter("junction_link", "link", ("link_type",), ("100", "102")),
        RoleFilter("ordinary_link", "link", ("link_type",), ("200", "201", "300")),
        RoleFilter("pocket_link", "link", ("turn",), ("1", "3")),
        RoleFilter("uturn_link", "link", ("turn",), ("3",)),
        RoleFilter("uturn_marker", "lane_line", ("line_kind",), ("502",)),
        RoleFilter("junction_node", "node", ("node_type1", "node_type2", "node_type3"), ("100",)),
    ),
    (("node_group", "node", ("group_id",)),),
    (("NT2_LINK", "r_link_id", "l_link_id"), ("NT2_LINK", "l_link_id", "r_link_id")),
)

SCHEMAS = (V2023, V2025)
