"""Small inputs written by hand: a street grid and a feed on it."""

OSM = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
%(nodes)s
<way id="100"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><tag k="highway" v="primary"/><tag k="name" v="Main Street"/><tag k="maxspeed" v="50"/></way>
<way id="101"><nd ref="4"/><nd ref="8"/><tag k="highway" v="residential"/><tag k="lanes" v="2"/></way>
<way id="102"><nd ref="8"/><nd ref="7"/><nd ref="6"/><nd ref="5"/><tag k="highway" v="primary"/><tag k="name" v="Back Road"/></way>
<way id="103"><nd ref="5"/><nd ref="1"/><tag k="highway" v="residential"/><tag k="maxspeed" v="30 mph"/></way>
<way id="104"><nd ref="2"/><nd ref="6"/><tag k="highway" v="tertiary"/><tag k="oneway" v="yes"/><tag k="lanes" v="2"/><tag k="turn:lanes" v="left|through;right"/></way>
<way id="105"><nd ref="20"/><nd ref="21"/><tag k="highway" v="residential"/></way>
<way id="106"><nd ref="1"/><nd ref="99"/><tag k="building" v="yes"/></way>
<relation id="900"><member type="way" ref="104" role="from"/><member type="node" ref="6" role="via"/><member type="way" ref="102" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="only_right_turn"/><tag k="except" v="psv"/></relation>
<relation id="901"><member type="way" ref="100" role="from"/><member type="way" ref="101" role="via"/><member type="way" ref="102" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_u_turn"/></relation>
</osm>
"""

# node -> (lon, lat): two streets of four nodes 0.002 degrees apart, and an island
PLACES = {1: (0.0, 0.0), 2: (0.002, 0.0), 3: (0.004, 0.0), 4: (0.006, 0.0), 5: (0.0, 0.003), 6: (0.002, 0.003), 7: (0.004, 0.003), 8: (0.006, 0.003), 20: (0.1, 0.1), 21: (0.101, 0.1)}
SIGNALS = {2}


def osm_xml() -> str:
    signal = '<tag k="highway" v="traffic_signals"/>'
    nodes = "\n".join(f'<node id="{i}" lat="{lat}" lon="{lon}">{signal if i in SIGNALS else ""}</node>' for i, (lon, lat) in PLACES.items())
    return OSM % {"nodes": nodes}


FEED = {
    "agency": "agency_id,agency_name\nA,Agency",
    "stops": '﻿stop_id,stop_name,stop_lat,stop_lon\nS1,"Main Street, West",0.0001,0.001\nS2,Main Street,0.0001,0.005\nS3,Back Road,0.0029,0.005\nS4,Nowhere,0.0014,0.0045\nS0,Zero,0,0',
    "routes": "route_id,route_short_name,route_type\nR1,1,3\nR2,T,0",
    "trips": "trip_id,route_id,service_id\nT1,R1,WD\nT2,R1,WD\nT3,R1,WE\nT4,R2,WD",
    "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time,timepoint\nT1,S1,1,08:00:00,08:00:00,1\nT1,S2,2,,,0\nT1,S3,3,08:20:00,08:21:00,1\nT2,S1,1,09:00:00,09:00:00,1\nT2,S2,2,,,0\nT2,S3,3,09:20:00,09:21:00,1\nT3,S1,1,10:00:00,10:00:00,1\nT3,S3,2,10:30:00,10:30:00,1\nT4,S4,1,24:10:00,24:10:00,1\nT4,S1,2,25:00:00,25:00:00,1",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20240101,20240107\nWE,0,0,0,0,0,1,1,20240101,20240107\nBAD,1,1,1,1,1,1,1,20240107,20240101",
    "calendar_dates": "service_id,date,exception_type\nWD,20240101,2\nWE,20240103,1\nNEW,20240104,1",
    "frequencies": "trip_id,start_time,end_time,headway_secs,exact_times\nT2,09:00:00,10:00:00,1200,0\nT2,09:35:00,09:50:00,600,1",
}


def write_feed(folder) -> str:
    for name, text in FEED.items():
        (folder / f"{name}.txt").write_text(text)
    return str(folder)
