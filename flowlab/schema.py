"""Schemas of the flow data model: explicit types, tolerant on read."""

from __future__ import annotations

RECORD = "struct<length:int,content_type:int,minor_version:int,major_version:int,record_number:int,handshake_type:int,header_start_byte:int,direction:int,time_epoch:double>"
FRAME = f"struct<tcp_length:int,frame_number:int,time_epoch:double,direction:int,tcp_header_offset:int,ip_header_length:int,tcp_header_length:int,tls_records:array<{RECORD}>>"
FLOW = f"src_ip string, src_port int, dst_ip string, dst_port int, tcp_header_length int, ip_header_length int, total_num_frames int, frames array<{FRAME}>, tls_records array<{RECORD}>"
PACKET = "frame_number long, time_epoch double, ip_src string, ip_dst string, protocol string, frame_len int, tcp_srcport int, tcp_dstport int, info string"
RESOLUTION = "ip string, domain string"
NF_STATS = "ts long, instanceid int, serviceid int, rx long, cost double, tx_drop long, rx_drop long"
TTL = "src_ip string, src_port int, dst_ip string, dst_port int, tv_sec long, tv_nsec long"
TRIAL = (
    "uuid_ string, accuracy double, trial_dir string, classifier string, binning_method string, num_bins int, day_train_start int, day_train_end int, seq_length int, seq_element_type string, hmm_length int, "
    "knn_num_neighbors int, seed int, hmm_init_prior string, hmm_num_iter int, ano_density_estimator string, bin_edges array<double>, max_bin_size int, label string, fp long, fn long, tp long, tn long, knn_fraction double, skip_tls_handshake boolean"
)

#: Content types and handshake types of TLS with their names.
CONTENT_TYPES = {20: "CHANGE_CIPHER_SPEC", 21: "ALERT", 22: "HANDSHAKE", 23: "APPLICATION_DATA"}
HANDSHAKE_TYPES = {0: "HELLO_REQUEST", 1: "CLIENT_HELLO", 2: "SERVER_HELLO", 4: "NEW_SESSION_TICKET", 11: "CERTIFICATE", 12: "SERVER_KEY_EXCHANGE", 14: "SERVER_HELLO_DONE", 16: "CLIENT_KEY_EXCHANGE", 20: "FINISHED"}
#: Protocol names of TLS rows, client to server and server to client.
TLS_NAMES = ("TLSv1", "TLSv1.2", "TLSv1.3")
TO_SERVER, TO_CLIENT = -1, 1
