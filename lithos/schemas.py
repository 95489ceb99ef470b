"""Tables of the model: real nulls for 'no segment' and 'no version', lengths kept with contents."""

COLLECTIONS = "id binary, internalid int, metadataid long"
DATA = "id long, casid struct<sha1:string,len:long>, usage int, storenum int"
CAS = "collectionid long, segment long, versionid long, dataid long"
VERSIONS = "versionid long, versiontime long, uniquifier int"
STORES = "storenum int, casstoreid binary"
CONNECTED_SERVERS = "servernum int, serverid binary, genid binary, securityserverid binary"
LOCAL_EVENTS = "eventid long, collectionid long, segment long, eventtype string, timestamp long, transactionid long, versionid long"
REPLICATED_EVENTS = "servernum int, " + LOCAL_EVENTS
SERVER_EVENTS = "eventid long, collectionid binary, eventtype string, timestamp long, transactionid long"
REPLICATED_SERVER_EVENTS = "servernum int, " + SERVER_EVENTS
EDGES = "parent string, name string, child string"
FORK_BLOCKS = "node long, fork string, block_index long, segment long"
SNAPSHOTS = "volume long, name string, versiontime long, uniquifier int, metadata map<string,string>"
