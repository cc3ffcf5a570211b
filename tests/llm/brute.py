"""Brute-force twins of the operators."""
import hashlib
import re
from collections import Counter
W=re.compile(r"[^\x20\x09-\x0D]+")
def sha(b): return hashlib.sha256(b).hexdigest()
def op2(rows,w=50):
    first={}
    enc=[(d,(t or '').encode()) for d,t in rows]
    for d,b in sorted(enc,key=lambda x:x[0]):
        for i in range(len(b)-w+1): first.setdefault(b[i:i+w],d)
    out={}
    for d,b in enc:
        m=bytearray(len(b))
        for i in range(len(b)-w+1):
            if first[b[i:i+w]]<d: m[i:i+w]=b'\1'*w
        kept=bytes(x for x,y in zip(b,m) if not y)
        out[d]=(len(b),sum(m),len(re.findall(b'\x01+',bytes(m))),sha(kept))
    return out
def op4(rows,w=20):
    first={}; enc=[(d,W.findall(t or '')) for d,t in rows]
    for d,b in sorted(enc,key=lambda x:x[0]):
        for i in range(len(b)-w+1): first.setdefault(tuple(b[i:i+w]),(d,i))
    out={}
    for d,b in enc:
        m=bytearray(len(b))
        for i in range(len(b)-w+1):
            if first[tuple(b[i:i+w])]<(d,i): m[i:i+w]=b'\1'*w
        out[d]=(len(b),sum(m),sha(' '.join(x for x,y in zip(b,m) if not y).encode()))
    return out
def shingles(t,n):
    w=W.findall(re.sub('[A-Z]',lambda m:m.group().lower(),t or ''))
    if not w: return set()
    return {tuple(w[i:i+n]) for i in range(len(w)-n+1)} if len(w)>=n else {tuple(w)}
def op10(rows,n=3,percent=90):
    sets={d:shingles(t,n) for d,t in rows}; root={d:d for d in sets}
    def find(x):
        while root[x]!=x: x=root[x]
        return x
    ids=sorted(sets,key=lambda d:len(sets[d]))
    for i,a in enumerate(ids):
        A=sets[a]
        if not A: continue
        for b in ids[i+1:]:
            B=sets[b]
            if 100*len(A)<percent*len(B): break
            s=len(A&B)
            if 100*s>=percent*(len(A)+len(B)-s):
                x,y=find(a),find(b); root[max(x,y)]=min(x,y)
    return {d:(len(sets[d]),find(d)) for d in sets}
def op6(rows):
    out={}
    for d,t in rows:
        t=t or ''; w=W.findall(t); n=len(w)
        c=Counter(tuple(w[i:i+5]) for i in range(n-4)); m=bytearray(n)
        for i in range(n-4):
            if c[tuple(w[i:i+5])]>1: m[i:i+5]=b'\1'*5
        seen=set(); dup=0
        for l in t.split('\n'):
            if W.search(l):
                dup+=l in seen; seen.add(l)
        out[d]=(n,sum(map(len,w)),sum(t.count(x) for x in '#*$%&|<>'),dup,sum(m),n<10 or 100*sum(m)>20*n)
    return out
def op3(rows):
    first={}; enc=[(d,(t or '').split('\n')) for d,t in rows]
    for d,b in sorted(enc,key=lambda x:x[0]):
        for i in range(len(b)-2):
            if any(x.strip(' \t\n\v\f\r') for x in b[i:i+3]): first.setdefault(tuple(b[i:i+3]),(d,i))
    out={}
    for d,b in enc:
        g=set()
        for i in range(len(b)-2):
            f=first.get(tuple(b[i:i+3]))
            if f and f<(d,i): g|={i,i+1,i+2}
        out[d]=(len(g),sha('\n'.join(x for i,x in enumerate(b) if i not in g).encode()))
    return out
